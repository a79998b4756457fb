"""Spatial queries between point tables through a grid of buckets: radius search, existence, k nearest, nearest distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cell_x": F.floor(F.col("x") / size).cast("long"), "cell_y": F.floor(F.col("y") / size).cast("long")})


def radius_search(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """queries(q_id, qx, qy) x points(p_id, x, y): pairs within ``radius`` (inclusive), with their distance.

    A query is sent to the nine cells around it and meets points by equality of cells, never all of them."""
    size = max(1.0, radius)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = queries.withColumn("s", F.explode(around))
    q = q.select("q_id", "qx", "qy", (F.floor(F.col("qx") / size).cast("long") + F.col("s.i")).alias("cell_x"), (F.floor(F.col("qy") / size).cast("long") + F.col("s.j")).alias("cell_y"))
    d = F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)
    return q.join(with_cell(points, size), ["cell_x", "cell_y"]).withColumn("dist", d).filter(F.col("dist") <= radius).select("q_id", "p_id", "dist")


def exists_within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(q_id, found) of every query."""
    hits = radius_search(queries, points, radius).groupBy("q_id").agg(F.lit(True).alias("found"))
    return queries.select("q_id").join(hits, "q_id", "left").select("q_id", F.coalesce("found", F.lit(False)).alias("found"))


def k_nearest(queries: DataFrame, points: DataFrame, radius: float, k: int) -> DataFrame:
    """The k nearest points within ``radius`` of each query, ties by p_id, ranked from 1."""
    w = Window.partitionBy("q_id").orderBy("dist", "p_id")
    return radius_search(queries, points, radius).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_distance(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(q_id, dist): -1 when nothing lies within ``radius``."""
    near = radius_search(queries, points, radius).groupBy("q_id").agg(F.min("dist").alias("dist"))
    return queries.select("q_id").join(near, "q_id", "left").select("q_id", F.coalesce("dist", F.lit(-1.0)).alias("dist"))
