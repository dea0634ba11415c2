"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.session import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one root, which is linked to no smaller node."""
    child = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    root = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = child.unionByName(root).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b) except the roots themselves.

    Alternates two rewirings until only stars are left, none if the edges are stars already: every node is linked to the
    smallest of its neighbours, first for the larger neighbours, then for the smaller ones. Both are a pre-aggregated
    minimum per node and a join with it. The minima are written first, so that both sides of the join are plain shuffles
    whose large partitions adaptive execution can split: a node with very many links is no hot group. The number of rounds
    grows with the logarithm of the longest path. Only the answer whether stars are left reaches the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = materialize(edges, "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialize(low, "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low).distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
