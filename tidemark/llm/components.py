"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its smallest neighbour.  Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("b"))
    return linked.filter("m < b").select(F.col("m").alias("a"), "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node of its component) for every node on an edge (a, b) of longs.

    Each round is written to the shared folder; a hot node is aggregated before it is shuffled, and its joins can be
    split.  Rounds grow with the logarithm of the longest path.
    """
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, before = materialize(ordered, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        now = materialize(_small_star(_large_star(now)), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
