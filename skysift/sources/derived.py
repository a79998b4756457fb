"""Image-shaped tables derived from the driver's business tables, deterministic in Spark and in SQL.

The pixel cube has 7 frames of 64 x 64 pixels; every event is a detection; frame metrics from orders by month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES, SIDE = 7, 64
#: Frame numbers kept for a session, of which a month of days uses 30 or 31, and pixels between the fields of sessions.
DAYS, FIELD = 32, 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, v): every pixel of every frame; cells without rows are 0, like registration voids."""
    found = (
        read(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_linenumber") - 1).cast("int").alias("frame"), (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x"))
        .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("v"))
    )
    grid = spark.range(FRAMES).select(F.col("id").cast("int").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return grid.join(found, ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


CUBE = f"""found AS (SELECT CAST(l_linenumber - 1 AS INTEGER) AS frame, CAST(l_orderkey % {SIDE} AS INTEGER) AS y, CAST(l_partkey % {SIDE} AS INTEGER) AS x,
  CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3),
cube AS (SELECT CAST(f.range AS INTEGER) AS frame, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, coalesce(found.v, 0) AS v
  FROM range({FRAMES}) f, range({SIDE}) a, range({SIDE}) b LEFT JOIN found ON found.frame = f.range AND found.y = a.range AND found.x = b.range)"""


def frame_rows(cube: DataFrame) -> DataFrame:
    """(frame, y, px): one array of shifted values a row; the layout for kernels."""
    return cube.groupBy("frame", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s")).select("frame", "y", F.col("s.v").alias("px"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, frame, det_id, x, y, flux, area, fwhm, elongation, peak_sigma, integrated_sigma, ts_ms, exposure_ms) of every event.

    Five users make a session, so sessions grow in number with the events and not in size. A session's frames are its days,
    numbered from ``session * DAYS``; its field lies ``FIELD`` pixels from the next one's."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    e = e.join(F.broadcast(e.agg(F.min("ts_ms").alias("t0")))).withColumn("session", F.expr("user_id div 5"))
    return e.select(
        "session",
        (F.col("session") * DAYS + F.expr("ts_ms div 86400000 - t0 div 86400000")).cast("int").alias("frame"),
        F.col("event_id").alias("det_id"),
        (F.col("session") * FIELD + F.col("event_id") * 7 % 101).cast("double").alias("x"),
        F.col("value").cast("double").alias("y"),
        (F.col("event_id") % 97 + 50).cast("double").alias("flux"),
        (F.col("event_id") % 40 + 1).cast("double").alias("area"),
        ((F.col("event_id") % 7 + 2) / F.lit(2.0)).alias("fwhm"),
        (F.lit(1.0) + (F.col("event_id") % 13) / F.lit(4.0)).alias("elongation"),
        (F.col("event_id") % 11).cast("double").alias("peak_sigma"),
        (F.col("event_id") % 23).cast("double").alias("integrated_sigma"),
        "ts_ms",
        (F.col("event_id") % 3 * 60000).cast("long").alias("exposure_ms"),
    )


DETECTIONS = f"""ev AS (SELECT event_id, user_id, value, user_id // 5 AS session, epoch_us(ts) // 1000 AS ts_ms FROM events),
det AS (SELECT session, CAST(session * {DAYS} + ts_ms // 86400000 - (SELECT min(ts_ms) // 86400000 FROM ev) AS INTEGER) AS frame, event_id AS det_id, CAST(session * {FIELD} + event_id * 7 % 101 AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y,
  CAST(event_id % 97 + 50 AS DOUBLE) AS flux, CAST(event_id % 40 + 1 AS DOUBLE) AS area,
  (event_id % 7 + 2) / 2.0::DOUBLE AS fwhm, 1.0::DOUBLE + (event_id % 13) / 4.0::DOUBLE AS elongation, CAST(event_id % 11 AS DOUBLE) AS peak_sigma, CAST(event_id % 23 AS DOUBLE) AS integrated_sigma,
  ts_ms, CAST(event_id % 3 * 60000 AS BIGINT) AS exposure_ms FROM ev)"""


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a month of orders, shaped like frame quality: (frame, background, noise, fwhm, ecc, bright_ecc, stars)."""
    return (
        read(spark, sf_dir, "orders")
        .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 1000).alias("a"), F.sum(F.col("o_custkey") % 100).alias("b"))
        .select(
            "month",
            F.round(F.col("a") / F.col("n"), 3).alias("background"),
            F.round(F.col("b") / F.col("n"), 3).alias("noise"),
            F.round(F.lit(2.0) + (F.col("b") % 31) / 10.0, 3).alias("fwhm"),
            F.round(F.lit(1.0) + (F.col("a") % 17) / 20.0, 3).alias("ecc"),
            F.when(F.col("a") % 5 != 0, F.round(F.lit(1.1) + (F.col("a") % 23) / 20.0, 3)).alias("bright_ecc"),
            F.col("n").alias("stars"),
        )
    )


METRICS = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_orderkey % 1000)::BIGINT AS a, sum(o_custkey % 100)::BIGINT AS b FROM orders GROUP BY 1),
metrics AS (SELECT month, round(a / n::DOUBLE, 3) AS background, round(b / n::DOUBLE, 3) AS noise, round(2.0::DOUBLE + (b % 31) / 10.0::DOUBLE, 3) AS fwhm, round(1.0::DOUBLE + (a % 17) / 20.0::DOUBLE, 3) AS ecc,
  CASE WHEN a % 5 <> 0 THEN round(1.1::DOUBLE + (a % 23) / 20.0::DOUBLE, 3) END AS bright_ecc, n AS stars FROM m)"""
