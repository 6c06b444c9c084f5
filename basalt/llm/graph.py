"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); a component is named by its least node.

    Neighbours are never gathered: a round takes the least neighbour by aggregation and joins it back. Each
    round's edges are written to the shared folder, so a lost executor costs one round at most. Rounds grow
    with the logarithm of the longest chain. The result is a table in the shared folder.
    """

    def least(pairs: DataFrame) -> DataFrame:
        # written, so that the join that follows can split the rows of a node with very many neighbours
        return materialize(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        # large star: every larger neighbour is tied to the least one
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both)
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        large = materialize(large)
        lower = least(large)
        small = large.join(lower, "a")
        tied = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        then = materialize(tied.filter("a <> b").distinct())
        drop(now, low, large, lower)
        now, before = then, seen
        seen = state(now)
        if seen == before:
            break
    tails = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialize(tails.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    drop(now)
    return out
