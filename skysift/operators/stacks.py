"""Order-statistic stacks over frames: one aggregation gives all kinds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import kth, lower_median, upper_median


def slow_index(n: int, fraction: float) -> int:
    """Sorted index of the slow-mover stack."""
    return min(n - 1, (n - 1) // 2 + int(np.floor(n * fraction + 0.5)) // 2)


def stack_pixels(pixels: DataFrame, keys: list[str], fraction: float = 0.75) -> DataFrame:
    """(keys, y, x, median, slow, maximum, tuner_median) from long pixels."""
    values = F.collect_list("v")
    got = pixels.groupBy(*keys, "y", "x").agg(values.alias("vs"), F.max("v").alias("maximum"))
    n = F.size("vs")
    slow = F.least(n - 1, F.floor((n - 1) / 2) + F.floor(F.floor(n * F.lit(fraction) + 0.5) / 2))
    return got.select(*keys, "y", "x", lower_median(F.col("vs")).alias("median"), kth(F.col("vs"), slow).alias("slow"), "maximum", upper_median(F.col("vs")).alias("tuner_median"))


def stack_rows(rows: DataFrame, fraction: float = 0.75) -> DataFrame:
    """(session_id, y, median, slow, maximum, tuner_median arrays) from row-layout frames, one selection a row band."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cube = np.array(table.column("px").to_pylist(), np.int32)
        n = len(cube)
        picks = {"median": (n - 1) // 2, "slow": slow_index(n, fraction), "maximum": n - 1, "tuner_median": n // 2}
        part = np.partition(cube, sorted(set(picks.values())), axis=0)
        cols = {"session_id": [key[0].as_py()], "y": pa.array([key[1].as_py()], pa.int32())}
        return pa.table(cols | {k: pa.array([part[i].tolist()], pa.list_(pa.int32())) for k, i in picks.items()})

    schema = "session_id string, y int, median array<int>, slow array<int>, maximum array<int>, tuner_median array<int>"
    return rows.select("session_id", "y", "px").groupBy("session_id", "y").applyInArrow(run, schema)


def stack_frame(stack: DataFrame, kind: str) -> DataFrame:
    """A stack as frame rows (session_id, seq_index = -1, y, px)."""
    return stack.select("session_id", F.lit(-1).alias("seq_index"), "y", F.col(kind).alias("px"))
