"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from expirylens.llm.common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (near.filter("b > a").join(least, "a").filter("b > m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges, roots included; root: the component's least node.

    Nodes are of any type that has an order. Only edges move, and no node's neighbours are gathered:
    each round takes minima per node and joins them back, so a hub with very many edges is pre-aggregated
    on the map side and a skewed join can be split. Rounds are stored in the shared folder. Their number
    grows with the logarithm of the longest path.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    while True:
        after = materialise(_small_star(_large_star(now)))
        row = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if row == mark:
            break
        mark = row
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
