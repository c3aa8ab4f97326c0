"""Connected components of an edge table by alternating stars (DataFrame functions only).

A round hangs every larger neighbour of a node on the node's smallest one (large star), then every smaller
neighbour likewise (small star).  Components end as stars around their smallest node.  Each round works on sums by key
and joins of stored tables, so a hub is neither collected nor windowed, and nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, level: int) -> DataFrame:
    """(u, v) with u > v, to the next such table."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"large-{level}")
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = common.materialize(large, f"large-edges-{level}")
    below = common.materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"small-{level}")
    moved = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = moved.unionByName(below.select("u", F.col("m").alias("v"))).distinct()
    small = common.materialize(small, f"small-edges-{level}")
    common.drop(edges, least, large, below)
    return small


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b) that isn't its component's smallest."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialize(edges, "component-edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, level = mark(edges), 0
    while seen[0]:
        edges = _stars(edges, level)
        now = mark(edges)
        if now == seen:
            break
        seen, level = now, level + 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
