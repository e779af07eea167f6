"""Connected components of an edge table, by contracting stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, spread_join


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (a, b: long) but the roots.

    Each round hangs every node below the smallest of its neighbourhood, once for larger and once for smaller
    neighbours, so a component of diameter d takes about log d rounds; every round lowers some node's neighbour
    until none can be, so the rounds end by themselves. Minima are aggregated before they meet the edges again, a
    node with very many neighbours meets its edges where they are, and only two numbers a round reach the driver.
    Rounds are written to the shared checkpoint folder. Loops, nulls and repeated edges are ignored; no edges give
    no rows.
    """
    held = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpoint(spread_join(both, least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        held = checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
