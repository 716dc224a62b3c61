"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lookup, written


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is moved to the smallest of the node and its neighbours."""
    both = edges.select("b", F.col("b").alias("other"), F.lit(1).alias("own")).unionByName(
        edges.select(F.col("a").alias("b"), F.col("b").alias("other"), F.lit(0).alias("own"))
    )
    least = both.groupBy("b").agg(F.min("other").alias("m"), F.sum("own").alias("_n")).where("_n > 0")
    return lookup(edges, least, "b", total, how="inner").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are moved to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    moved = lookup(edges, least, "a", total, how="inner")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(moved.select("a", F.col("m").alias("b")))


def _is_star(edges: DataFrame) -> bool:
    """No node has two edges down, and no lower end has one."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    return twice.isEmpty() and chained.isEmpty()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that isn't the smallest of its component.

    Each round is written to the shared folder, so nothing is recomputed when an executor is lost.
    No node's edges meet in one task: minima are pre-aggregated, and hot nodes are joined by broadcast.
    """
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(down.distinct(), f"{label}-edges")
    while not _is_star(edges):
        edges = written(_large_star(edges, edges.count()).distinct(), f"{label}-large")
        edges = written(_small_star(edges, edges.count()).distinct(), f"{label}-small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
