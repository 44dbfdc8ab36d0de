"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import stored

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each linked node; the component is its smallest node.

    Alternates large-star and small-star steps: each node hands its larger, then its smaller neighbours to the
    smallest one. Links that a step repeats collapse before the next, every step is a table, and a chain of n
    links takes about log n rounds.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
        larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("least").alias("b"))
        large = larger.where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        smaller = large.join(least, "a")
        small = smaller.select(F.col("a"), F.col("least").alias("b")).union(smaller.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = stored(small.distinct(), "links")
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
