"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang nodes on the smallest node that they see.

    large: every neighbour greater than a node is linked to the smallest node
    of its neighbourhood. Otherwise: the neighbours not greater than a node, and
    the node itself, are linked to the smallest of them. Both keep components.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = low.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = low.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Rows with a NULL end and links from a node to itself are ignored; repeated
    links count once. Each round is written to the shared folder, and rounds
    end when a round leaves the links as they were; their number grows with the
    logarithm of the longest chain.
    """
    edges = settle(edges.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        for large in (True, False):
            edges = settle(_stars(edges, large).where("a <> b").distinct(), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    pairs = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
