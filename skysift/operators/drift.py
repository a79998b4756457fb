"""Border drift: valid bounds, drift vectors, padding, void radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shifted value that a valid pixel must exceed.
VOID_LEVEL = 8


def _num(x: int | str) -> Column:
    """A number, or the column of that name."""
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _bounds(pixels: DataFrame, keys: list[str], axis: str, extent: int | str, across: int | str, level: int) -> DataFrame:
    lines = pixels.groupBy(*keys, axis).agg(F.count_if(F.col("v") > level).alias("ok"))
    good = F.when(F.col("ok") > F.floor(_num(across) / 20), F.col(axis))
    return lines.groupBy(*keys).agg(F.coalesce(F.min(good), F.lit(0)).alias(f"min_{axis}"), F.coalesce(F.max(good), F.max(_num(extent)) - 1).alias(f"max_{axis}"))


def valid_bounds(pixels: DataFrame, keys: list[str], width: int | str, height: int | str, level: int = VOID_LEVEL) -> DataFrame:
    """(keys, min_y, max_y, min_x, max_x): first and last lines with strictly more than 1/20 valid pixels; none: all.
    ``width`` and ``height`` are numbers, or key columns where sessions differ in size."""
    return _bounds(pixels, keys, "y", height, width, level).join(_bounds(pixels, keys, "x", width, height, level), keys)


def drift_vectors(bounds: DataFrame, keys: list[str], width: int | str, height: int | str) -> DataFrame:
    """(keys, dx, dy, padding)."""
    left, top = F.col("min_x"), F.col("min_y")
    right, bottom = _num(width) - 1 - F.col("max_x"), _num(height) - 1 - F.col("max_y")
    return bounds.select(*keys, (left - right).alias("dx"), (top - bottom).alias("dy"), F.greatest(left, right, top, bottom).alias("padding"))


def void_radius(vectors: DataFrame, current: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of ``keys``): the radius that keeps sources off the widest border."""
    pad = F.max("padding")
    return vectors.groupBy(*keys).agg(F.when(pad > 0, F.greatest(F.lit(current), pad + 10)).otherwise(current).cast("int").alias("void_radius"))
