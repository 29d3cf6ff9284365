"""Connected components of a graph of links, by alternating large and small stars: the number of rounds grows with the logarithm of the graph, also for long chains, and each round is two shuffles of short rows. Nothing of it is collected but a count and a checksum, which tell that a round has changed nothing. Null nodes and links of a node with itself are left out; no links give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large or small star over edges (a, b) with a > b. The smallest neighbour of a node comes from a map-side combined minimum."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of distinct edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) in any order, with repeats: node, component (the smallest node that is reachable) for all nodes in links between different nodes."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        new = stored(_star(_star(edges, large=True), large=False), "edges")
        mark, old = _mark(new), mark
        edges = new
        if mark == old:
            break
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
