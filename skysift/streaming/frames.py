"""Frames as a stream: extraction needs no state; per-frame counts are windowed by capture time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..operators import sources
from ..sources.frames import SCHEMA, frame_rows


def read_frames(spark, path: str) -> DataFrame:
    """Parquet files of frames as they arrive."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def extract_batch(frames: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """For foreachBatch: the sources of a micro-batch's frames."""
    return sources.extract(frame_rows(frames), config.detection_sigma_multiplier, config.min_detection_pixels, config)


def frame_rate(frames: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Frames by session and capture-time window; frames of unknown time do not count."""
    timed = frames.filter("ts_ms >= 0").withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy("session_id", F.window("ts", window)).agg(F.count("*").alias("frames"))
