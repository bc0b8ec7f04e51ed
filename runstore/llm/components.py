"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with an edge downwards has one only, to a node that has none."""
    role = lambda c, down: edges.select(F.col(c).alias("node"), F.lit(down).alias("down"))
    roles = role("u", 1).unionByName(role("v", 0)).groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return roles.where("down > 1 or (down > 0 and least = 0)").isEmpty()


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    Each step keeps as many edges as nodes at most. The minima are written before they are joined,
    so that both sides of the join are plain exchanges, whose hot keys Spark can split. Steps end
    when all components are stars around their smallest node; their number grows with the logarithm
    of the longest path.
    """
    at = ws.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    while not _are_stars(at):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = ws.cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        ws.drop(low)
        low = ws.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        ws.drop(at, low, large)
        at = after
    roots = at.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
