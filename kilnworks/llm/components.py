"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.scratch import cut, drop


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    # Large star: the larger neighbours of a node move to the least of its neighbours and itself.
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    # Small star: the smaller neighbours of a node, and the node, move to the least of them.
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return small.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), component being the least node that links reach.

    Each round is written to the shared folder, and the one before removed; rounds grow with the logarithm of the longest chain, and no more
    than a count and a checksum of a round reach the driver.
    """
    edges = cut(edges.select("a", "b").filter("a != b").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        last, edges = edges, cut(_stars(edges), "links")
        drop(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
