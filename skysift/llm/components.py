"""Connected components by alternating large-star and small-star (Kiveris et al., 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_group_min

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
    )
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    near = with_group_min(_both(edges), ["u"], "v", "m", by="v")
    return near.filter("v > u").select(F.least("m", "u").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them (edges have a < b)."""
    near = with_group_min(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), ["u"], "v", "m", by="v")
    own = near.select(F.col("m").alias("a"), F.col("u").alias("b"))
    rest = near.filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return own.unionByName(rest).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``(a, b), in any order, repeated or with loops -> (node, component) for every node that has a link.

    ``component`` is the smallest node reachable. Each round is written to the shared folder, so a lost executor costs
    one round at most; hot nodes are spread by salting, and nothing but two numbers a round reaches the driver.
    No edges: no rows.
    """
    tidy = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    now = materialize(tidy, "cc")
    before = _state(now)
    if not before[0]:
        return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    for _ in range(MAX_ROUNDS):
        now = materialize(_small_star(_large_star(now)), "cc")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
