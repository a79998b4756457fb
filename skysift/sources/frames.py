"""Frames: in-memory construction, validation, order, image files, and the long and row layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import decode

SCHEMA = "session_id string, seq_index int, filename string, height int, width int, ts_ms bigint, exposure_ms bigint, px array<array<smallint>>"


def frames_from_arrays(spark: SparkSession, images: list[np.ndarray], session_id: str = "s", ts_ms: list[int] | None = None, exposure_ms: int = -1, seq: list[int] | None = None) -> DataFrame:
    """Frames of stored signed 16-bit values; -1 stands for an unknown time or exposure."""
    rows = [
        (session_id, seq[k] if seq else k, f"frame_{k}.img", *a.shape, ts_ms[k] if ts_ms else -1, exposure_ms, a.astype(np.int16).tolist())
        for k, a in enumerate(images)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def with_frame_pos(frames: DataFrame) -> DataFrame:
    """``frame_pos`` from 0 by seq_index within the session. Only the keys are sorted; pixels stay where they are."""
    keys = frames.select("session_id", "seq_index").distinct()
    pos = keys.withColumn("frame_pos", F.row_number().over(Window.partitionBy("session_id").orderBy("seq_index")) - 1)
    return frames.join(pos, ["session_id", "seq_index"])


def check_sizes(frames: DataFrame) -> None:
    """Raise ValueError unless each session's frames have one size; one small aggregate."""
    bad = frames.groupBy("session_id").agg(F.count_distinct("height", "width").alias("n")).filter("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"frames of session {bad[0]['session_id']} differ in size")


def frame_rows(frames: DataFrame, *own: str) -> DataFrame:
    """(session_id, seq_index, [own columns,] y, px array<int>) in the shifted domain."""
    rows = frames.select("session_id", "seq_index", *own, F.posexplode("px").alias("y", "row"))
    return rows.select("session_id", "seq_index", *own, "y", F.transform("row", decode).alias("px"))


def pixels(frames: DataFrame, *own: str) -> DataFrame:
    """(session_id, seq_index, [own columns,] y, x, v): the long layout, for small frames and histograms."""
    return frame_rows(frames, *own).select("session_id", "seq_index", *own, "y", F.posexplode("px").alias("x", "v"))


def crop(rows: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A rectangle of row-layout frames, moved to the origin; the row filter reaches the scan."""
    inside = rows.filter((F.col("y") >= y) & (F.col("y") < y + height))
    return inside.withColumns({"y": F.col("y") - y, "px": F.slice("px", x + 1, width)})


def _pgm(data: bytes) -> np.ndarray:
    """A binary grey map (P5) as stored signed 16-bit values."""
    tokens, at = [], 0
    while len(tokens) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        tokens.append(data[at:end])
        at = end
    if tokens[0] != b"P5":
        raise ValueError("not a binary grey map")
    width, height, top = map(int, tokens[1:])
    raw = np.frombuffer(data, ">u2" if top > 255 else np.uint8, width * height, at + 1).astype(np.int32)
    return (raw - 32768).astype(np.int16).reshape(height, width)


def read_pgm(spark: SparkSession, path: str, session_id: str = "s") -> DataFrame:
    """Frames from binary grey maps, decoded on the executors; the order of file names is the sequence."""
    files = spark.read.format("binaryFile").load(path)
    order = files.select("path").withColumn("seq_index", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = [_pgm(x) for x in b.column(2).to_pylist()]
            cols = [
                pa.array([session_id] * b.num_rows), b.column(0), b.column(1), pa.array([a.shape[0] for a in images], pa.int32()), pa.array([a.shape[1] for a in images], pa.int32()),
                pa.array([-1] * b.num_rows, pa.int64()), pa.array([-1] * b.num_rows, pa.int64()), pa.array([a.tolist() for a in images], pa.list_(pa.list_(pa.int16()))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["session_id", "seq_index", "filename", "height", "width", "ts_ms", "exposure_ms", "px"])

    rows = files.select("path", "content").join(order, "path").select("seq_index", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return rows.mapInArrow(run, SCHEMA)
