"""Stationary reference: masks, dilation, overlap fractions, vetoes, slow movers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..functions.columns import upper_median


def engine_radius(jitter: float) -> int:
    return max(1, math.floor(jitter / 2 + 0.5))


def tuner_radius(jitter: float) -> int:
    return math.ceil(jitter)


def dilated_mask(pixels: DataFrame, keys: list[str], radius: int, width: int | str, height: int | str) -> DataFrame:
    """Distinct (keys, y, x) within ``radius`` of any given pixel (integer disc), clipped to the sensor; ``width`` and ``height``
    are numbers, or key columns where sessions differ in size."""
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc])
    moved = pixels.select(*keys, "y", "x").distinct().withColumn("s", F.explode(shifts)).select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return moved.filter(f"x >= 0 and y >= 0 and x < {width} and y < {height}").distinct()


def footprint_pixels(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.select(*keys, F.explode("footprint").alias("p")).select(*keys, "p.x", "p.y", "p.v")


def overlap(footprints: DataFrame, mask: DataFrame, keys: list[str], mask_keys: list[str], bounds: tuple[int, int] | None = None) -> DataFrame:
    """(keys, overlap): share of a footprint's pixels in the mask; with ``bounds`` (width, height) only pixels inside count."""
    if bounds:
        footprints = footprints.filter(f"x >= 0 and y >= 0 and x < {bounds[0]} and y < {bounds[1]}")
    hits = footprints.join(mask.withColumn("_hit", F.lit(1)), [*mask_keys, "y", "x"], "left")
    return hits.groupBy(*keys).agg((F.count("_hit") / F.count("*")).alias("overlap"))


def veto(objects: DataFrame, overlaps: DataFrame, keys: list[str], config: DetectionConfig) -> DataFrame:
    """``objects`` with overlap (no footprint: 0) and is_purged (strictly above the limit)."""
    out = objects.join(overlaps, keys, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    return out.withColumn("is_purged", F.col("overlap") > config.max_mask_overlap_fraction)


def star_map(vetoed: DataFrame, frame_keys: list[str]) -> DataFrame:
    """Point sources before, after and purged, by frame."""
    return vetoed.filter(~F.col("is_streak")).groupBy(*frame_keys).agg(F.count("*").alias("initial"), F.count_if(~F.col("is_purged")).alias("surviving"), F.count_if("is_purged").alias("purged"))


def elongation_limit(objects: DataFrame, keys: list[str], config: DetectionConfig) -> DataFrame:
    """(keys, n, med, mad, threshold): 3.0 below ten objects, else median plus scaled deviation (floored at 0.1)."""
    e = objects.groupBy(*keys).agg(F.collect_list("elongation").alias("e"))
    e = e.withColumn("med", upper_median(F.col("e"))).withColumn("mad", F.greatest(F.lit(0.1), upper_median(F.transform("e", lambda v: F.abs(v - F.col("med"))))))
    dynamic = F.col("med") + F.col("mad") * config.slow_mover_baseline_mad_multiplier
    return e.select(*keys, F.size("e").alias("n"), "med", "mad", F.when(F.size("e") >= 10, dynamic).otherwise(3.0).alias("threshold"))


def residual_flux(footprints: DataFrame, stacks: DataFrame, keys: list[str], stack_keys: list[str]) -> DataFrame:
    """(keys, fraction, residual, slow_flux, median_flux, pixels) of footprints over the stacks; pixels outside do not count."""
    j = footprints.drop("v").join(stacks.select(*stack_keys, "y", "x", "slow", "median"), [*stack_keys, "y", "x"])
    g = j.groupBy(*keys).agg(F.sum(F.greatest(F.col("slow") - F.col("median"), F.lit(0))).alias("residual"), F.sum("slow").alias("slow_flux"), F.sum("median").alias("median_flux"), F.count("*").alias("pixels"))
    return g.withColumn("fraction", F.when(F.col("slow_flux") > 0, F.col("residual") / F.when(F.col("slow_flux") > 0, F.col("slow_flux"))).otherwise(0.0))


def slow_mover_verdicts(candidates: DataFrame, limits: DataFrame, keys: list[str], config: DetectionConfig) -> DataFrame:
    """Candidates (elongation, overlap, fraction) with a verdict, tested in order: elongation, low, high, residual."""
    lo = max(0.0, min(1.0, config.slow_mover_median_support_overlap_fraction))
    hi = max(lo, min(1.0, config.slow_mover_median_support_max_overlap_fraction))
    least = max(0.0, min(1.0, config.slow_mover_residual_footprint_min_flux_fraction))
    verdict = F.when(F.col("elongation") < F.col("threshold"), "elongation").when(F.col("overlap") < lo, "low_support").when(F.col("overlap") > hi, "high_support")
    if config.enable_slow_mover_residual_footprint_filtering:
        verdict = verdict.when(F.coalesce("fraction", F.lit(0.0)) < least, "residual")
    return candidates.join(limits.select(*keys, "threshold"), keys).withColumn("verdict", verdict.otherwise("accepted"))


def slow_mover_summary(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda *names: F.count_if(F.col("verdict").isin(*names))
    return verdicts.groupBy(*keys).agg(
        F.count("*").alias("raw"), F.count_if(F.col("verdict") != "elongation").alias("evaluated"), count("low_support").alias("low_support"), count("high_support").alias("high_support"),
        count("residual").alias("low_residual"), count("accepted").alias("accepted"),
        F.coalesce(F.avg(F.when(F.col("verdict") != "elongation", F.col("overlap"))), F.lit(0.0)).alias("mean_overlap"),
        F.coalesce(F.avg(F.when(F.col("verdict") == "accepted", F.col("fraction"))), F.lit(0.0)).alias("mean_fraction"),
    )
