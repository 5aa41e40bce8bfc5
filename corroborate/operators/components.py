"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.storage import checkpointed, cleaned


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that keep ``edges`` (a > b) from being stars: those that point to two, or point and are pointed to."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; a <> b); the root is the least node of its component.

    Each round runs as joins and groupings and is checkpointed in the shared folder; only
    whether all are stars reaches the driver. The number of rounds grows as the logarithm
    of the longest chain; pairs and stars need one.
    """
    edges = checkpointed(edges.filter("a <> b").distinct())
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        with cleaned(edges.sparkSession):
            if _unfinished(edges).isEmpty():
                break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
