"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node of the neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).filter("x < y") \
        .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that has a link; the component is its least node.

    ``links`` has the columns ``a`` and ``b``.  Each round is written to the shared folder, and
    the rounds end when neither star moves a link; a chain of n nodes takes about log n rounds.
    Null ends and links of a node to itself are left out.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        found = edges.agg(F.count("*"), F.sum("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == mark:
            break
        mark = found
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
