"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = up.groupBy("u").agg(F.min("v").alias("m"))
    moved = up.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b")
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that has an edge: component is the smallest node reachable.

    edges: columns a < b, of one orderable type. A round is two joins; rounds grow with the logarithm of the
    longest chain. Each round is written to the shared folder. A hot node's edges are split by adaptive skew joins.
    """
    edges = materialize(edges.select("a", "b").filter("a < b").distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen is not None and tuple(mark) == seen or mark[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        seen = tuple(mark)
        edges = materialize(_small_star(_large_star(edges)), "edges")
