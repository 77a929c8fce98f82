"""Connected components by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour (or the node, if it is less)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b")))


def stars(edges: DataFrame, most: int = 50) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``a``, ``b``): the least node it is connected with, itself included.

    Hot nodes are summed up before the shuffle and their joins can be split; each round is written to the shared folder.
    """
    now, seen = edges.select("a", "b").where("a <> b").distinct(), None
    for _ in range(most):
        now = materialise(_small(_large(now).where("a <> b")).where("a <> b").distinct(), "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if state == seen:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
        seen = state
    raise RuntimeError(f"components did not settle in {most} rounds")
