"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every id in ``edges`` (columns a, b).

    Each round hangs larger neighbours, then smaller ones, under the smallest; rounds grow with the logarithm of the longest
    path. Minima are taken by partial aggregation and rejoined, so a hub of any degree is never collected; each round is
    written to the checkpoint folder, and the round before it is deleted. Self-loops and repeated edges don't matter; no edges give no rows."""
    now, place = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        (now, place), before = written(small), place
        dropped(now.sparkSession, before)
        if (then := _state(now)) == state:
            break
        state = then
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
