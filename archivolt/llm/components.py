"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """pairs: u, v.  u, v, m: the least of u and all its v.  Counted per u before the join, which may be skewed."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a: then each b is its component's smallest node."""
    twice = edges.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("bad")).filter("bad").select("a")
    inner = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, component: the smallest node that edges (a, b: longs) reach, for each node that has an edge to another.

    Each round only lowers what nodes point to, and rounds go on until nothing can be lowered (about as many as the logarithm of the longest path)."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not _is_forest_of_stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = _least(down)
        small = low.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(small.filter("a <> b").distinct(), label, (now,))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
