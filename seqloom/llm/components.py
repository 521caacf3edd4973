"""Connected components of a table of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> (id, component): the smallest id that each linked id reaches.

    Large-star and small-star steps (each vertex hangs its larger, then its smaller neighbours onto the
    smallest one) are repeated until nothing changes: a number of rounds that grows with the logarithm of
    the input. A vertex's minimum is made by a partial aggregate, so a hub is no hot group.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("a").alias("b"), F.col("m").alias("a")).where("a <> b").unionByName(least.select("b", F.col("m").alias("a")))
        edges = cut(small.distinct())
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
