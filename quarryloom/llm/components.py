"""Connected components by alternating large and small stars, on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import shared


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) rows with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): the least id that it reaches.

    Each round is written to the shared folder. A round changes nothing once every node
    hangs on its least one; the number of rounds grows with the logarithm of the longest path.
    """
    edges = shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", few=True)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = shared.written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", few=True)
        before, now = now, state(edges)
        if now == before:
            break
    pairs = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return pairs.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
