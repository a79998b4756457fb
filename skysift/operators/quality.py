"""Frame quality, robust session statistics, rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..functions.columns import upper_median

REASONS = {
    "stars": "Star Count dropped anomalously low",
    "fwhm": "FWHM spiked (Blurry image)",
    "ecc": "Eccentricity spiked (Tracking error/Wind)",
    "bright": "Bright-star eccentricity spiked (Tracking error/Wind)",
    "background": "Background deviation (Clouds/Light leak)",
}


def frame_quality(objects: DataFrame, background: DataFrame, keys: list[str], config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """(keys, background, noise, fwhm, ecc, bright_ecc, stars, shape_stars, bright_stars, fwhm_stars); frames without sources count."""
    shaped = ~F.col("is_streak")
    limit = max(config.quality_sigma_multiplier, config.quality_sigma_multiplier + config.quality_bright_star_peak_sigma_offset)
    bright = shaped & (F.col("peak_sigma") >= limit)
    round_ = shaped & (F.col("elongation") < config.quality_max_elongation_for_fwhm)
    stats = objects.groupBy(*keys).agg(
        F.count("*").alias("stars"), F.count_if(shaped).alias("shape_stars"), F.count_if(bright).alias("bright_stars"), F.count_if(round_).alias("fwhm_stars"),
        F.median(F.when(round_, F.col("fwhm"))).alias("f"), F.median(F.when(shaped, F.col("elongation"))).alias("e"), F.median(F.when(bright, F.col("elongation"))).alias("b"),
    )
    out = background.select(*keys, F.col("median").alias("background"), F.col("sigma").alias("noise")).join(stats, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        *keys, "background", "noise", F.coalesce("f", F.lit(config.error_fallback_value)).alias("fwhm"), F.coalesce("e", F.lit(config.error_fallback_value)).alias("ecc"),
        F.when(F.col("bright_stars") >= config.quality_bright_star_min_stars, F.col("b")).alias("bright_ecc"), zero("stars"), zero("shape_stars"), zero("bright_stars"), zero("fwhm_stars"),
    )


def robust_stats(df: DataFrame, keys: list[str], columns: list[str], config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """(keys, <c>_med, <c>_sig): sorted index n/2, and 1.4826 times the like-indexed deviation; 0 becomes the fallback."""
    lists = df.groupBy(*keys).agg(*[F.collect_list(F.col(c).cast("double")).alias(c) for c in columns])
    meds = lists.withColumns({f"{c}_med": upper_median(F.col(c)) for c in columns})

    def sigma(c: str):
        dev = upper_median(F.transform(c, lambda x: F.abs(x - F.col(f"{c}_med")))) * 1.4826
        return F.when(dev == 0, config.zero_sigma_fallback).otherwise(dev)

    return meds.withColumns({f"{c}_sig": sigma(c) for c in columns}).withColumns({f"{c}_n": F.size(c) for c in columns}).drop(*columns)


def session_thresholds(metrics: DataFrame, keys: list[str], config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """One row a session; sessions of fewer than min_frames_for_analysis frames have none."""
    s = robust_stats(metrics, keys, ["stars", "fwhm", "ecc", "background", "bright_ecc"], config).filter(F.col("stars_n") >= config.min_frames_for_analysis)
    med, sig = (lambda c: F.col(f"{c}_med")), (lambda c: F.col(f"{c}_sig"))
    envelope = lambda c, k, least: F.greatest(med(c) + k * sig(c), med(c) + least)
    off = F.greatest(config.background_sigma_deviation * sig("background"), F.lit(config.min_background_deviation_adu))
    has_bright = F.lit(config.enable_bright_star_eccentricity_filter) & (F.col("bright_ecc_n") >= config.min_frames_for_analysis)
    return s.select(
        *keys,
        (med("stars") - config.star_count_sigma_deviation * sig("stars")).alias("min_stars"),
        envelope("fwhm", config.fwhm_sigma_deviation, config.min_fwhm_envelope).alias("max_fwhm"),
        envelope("ecc", config.eccentricity_sigma_deviation, config.min_eccentricity_envelope).alias("max_ecc"),
        F.when(has_bright, envelope("bright_ecc", config.bright_star_eccentricity_sigma_deviation, config.min_bright_star_eccentricity_envelope)).alias("max_bright_ecc"),
        med("background").alias("base_background"),
        off.alias("max_background_off"),
    )


def reject_frames(metrics: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """``metrics`` with is_rejected and reason; the first rule that fails names it. Limits are one row a session."""
    m = metrics.join(limits, keys, "left")
    reason = (
        F.when(F.col("stars") < F.col("min_stars"), REASONS["stars"])
        .when(F.col("fwhm") > F.col("max_fwhm"), REASONS["fwhm"])
        .when(F.col("ecc") > F.col("max_ecc"), REASONS["ecc"])
        .when(F.col("bright_ecc") > F.col("max_bright_ecc"), REASONS["bright"])
        .when(F.abs(F.col("background") - F.col("base_background")) > F.col("max_background_off"), REASONS["background"])
        .otherwise("OK")
    )
    out = m.withColumn("reason", reason)
    return out.select(*metrics.columns, (F.col("reason") != "OK").alias("is_rejected"), "reason")


def kept_frames(rejected: DataFrame, session: list[str], order: str) -> DataFrame:
    """Kept frames, numbered again from 0 as ``frame_pos``."""
    return rejected.filter(~F.col("is_rejected")).withColumn("frame_pos", F.row_number().over(Window.partitionBy(*session).orderBy(order)) - 1)
