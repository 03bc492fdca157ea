"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) links, the component being its
    smallest node.

    Each round every node hands its smallest neighbour to the others: first to the
    larger ones, then to all. Minima are taken before the shuffle and handed out by
    a join whose large partitions Spark splits, so a node with very many links is
    no task of its own. Rounds grow with the logarithm of the longest path.
    """
    edges = written(_pointing_down(links.select("a", "b")).distinct(), "links")
    seen = None
    while True:
        edges = written(_small_star(_large_star(edges)), "links")
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()


def _pointing_down(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = _pointing_down(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    handed = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
