"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least of its neighbourhood."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them. Edges have a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return (e.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) edges to (node, component): every node of an edge with the least node it can reach.

    No node's neighbours are ever gathered: stars are minima (partial aggregates) and joins.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    Nodes without an edge, and edges from a node to itself, give no row.
    """
    e = scratch.table(edges.filter(F.col("a") != F.col("b"))
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        new = scratch.table(_small_star(_large_star(e)), "star")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
