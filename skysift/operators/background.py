"""Histogram, iterative sigma-clipped background, thresholds, seed and grow predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectionConfig


def histogram(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, n)."""
    return pixels.groupBy(*keys, "v").agg(F.count("*").alias("n"))


def clipped_background(hist: DataFrame, keys: list[str], config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """(keys, median, sigma). The median is the first bin whose cumulative count reaches half (integer) of what is in
    bounds; bounds move to median -/+ factor * sigma. One exchange on the keys serves all rounds."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumns({"lo": F.lit(0), "hi": F.lit(65535), "med": F.lit(0.0), "sig": F.lit(0.0)})
    for _ in range(config.bg_clipping_iterations):
        inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        h = h.withColumn("c", F.when(inside, F.col("n")).otherwise(0))
        h = h.withColumns({"tot": F.sum("c").over(whole), "cum": F.sum("c").over(upto)})
        half = F.expr("tot div 2")
        first = F.min(F.when((F.col("c") > 0) & (F.col("cum") >= half), F.col("v"))).over(whole)
        h = h.withColumn("m", F.when(F.col("tot") == 0, F.col("med")).when(half == 0, F.col("lo").cast("double")).otherwise(first.cast("double")))
        spread = F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")) * F.col("c")).over(whole)
        h = h.withColumn("s", F.when(F.col("tot") == 0, F.col("sig")).otherwise(F.sqrt(spread / F.greatest(F.col("tot"), F.lit(1)))))
        step = F.col("s") * config.bg_clipping_factor
        h = h.withColumns(
            {
                "lo": F.greatest(F.lit(0), F.floor(F.col("m") - step).cast("int")),
                "hi": F.least(F.lit(65535), F.ceil(F.col("m") + step).cast("int")),
                "med": F.col("m"),
                "sig": F.col("s"),
            }
        )
    return h.groupBy(*keys).agg(F.first("med").alias("median"), F.first("sig").alias("sigma"))


def thresholds(background: DataFrame, seed_sigma: float, config: DetectionConfig) -> DataFrame:
    return background.withColumns(
        {
            "seed": F.col("median") + F.col("sigma") * seed_sigma,
            "grow": F.col("median") + F.col("sigma") * config.grow_sigma_multiplier,
            "void": F.col("median") * config.void_threshold_fraction,
        }
    )


def above(pixels: DataFrame, limits: DataFrame, keys: list[str], which: str) -> DataFrame:
    """Pixels strictly above a threshold of their frame; one row a frame is broadcast."""
    return pixels.join(F.broadcast(limits.select(*keys, which)), keys).filter(F.col("v") > F.col(which)).drop(which)
