"""Connected components of a link table, by alternating stars.

Every round points each node's larger neighbours to its smallest one, then each node
and its smaller neighbours to the smallest; links to one centre stay linear in a
group's size. Rounds grow with the logarithm of the longest chain. Each round is
written to the shared folder, and they end when all links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from litsieve.session import durable


def _star(both: DataFrame, low: DataFrame, larger: bool) -> DataFrame:
    """Links (v, m): neighbours v of u, above (or below) u, to u's least neighbour m."""
    joined = both.join(low, "u")
    side = F.col("v") > F.col("u") if larger else F.col("v") < F.col("u")
    moved = joined.filter(side & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one centre and no centre points on."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    per_node = roles.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not per_node.filter("out > 1 OR (out = 1 AND into = 1)").head(1)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): component is the least node."""
    edges = durable(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    while not _are_stars(edges):
        # Large star: each node's larger neighbours go to its least neighbour or itself.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = durable(_star(both, low, True).distinct(), "large")
        # Small star: a node and its smaller neighbours go to the least of them.
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = _star(down, low, False).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = durable(moved.filter("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
