"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges stay in tables: every round is written to the scratch folder, and only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large star) or smaller (small star) neighbours of each node to the smallest of its
    neighbours and itself. Minima are combined before the shuffle; a node with many edges is a skewed join side,
    which Spark can split."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = both.join(least, "u")
    if large:
        linked = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges (a, b); nodes are longs."""
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    current = scratch.table(ordered, "edges-0")
    before = mark(current)
    for k in range(1, 200):
        following = scratch.table(_star(_star(current, True), False), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        now = mark(following)
        current = following
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
