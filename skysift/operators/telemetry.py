"""Counters over stage outputs and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extraction_stats(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.groupBy(*keys).agg(F.count("*").alias("objects"), F.count_if("is_streak").alias("streaks"), F.first("median").alias("median"), F.first("sigma").alias("sigma"))


def rejection_stats(rejected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason, frames)."""
    return rejected.groupBy(*keys, "reason").agg(F.count("*").alias("frames"))


def report(rows: dict[str, list[dict]]) -> str:
    """A plain-text report of small aggregates: a heading and one line a row for each."""
    out = []
    for title, lines in rows.items():
        out.append(f"== {title} ({len(lines)})")
        out += ["  " + ", ".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in line.items()) for line in lines]
    return "\n".join(out)
