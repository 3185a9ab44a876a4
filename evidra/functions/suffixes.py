"""Longest common beginnings by order: in sorted texts, the one that shares most letters with a word is next to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.ranges import range_of


def common_length(a: Column, b: Column) -> Column:
    """How many first characters two texts share; by halving, so the work is the logarithm of the shorter one's length in comparisons."""
    shorter = F.least(F.length(a), F.length(b))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.left(a, middle) == F.left(b, middle)
        return F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle - 1).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(shorter + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), shorter.alias("high")), step)["low"]


def common_beginnings(words: DataFrame, word: str, texts: DataFrame, text: str) -> DataFrame:
    """(word, n): how many letters each distinct word shares at most with the beginning of any of the distinct texts; 0 without texts.

    Words and texts are put in one order, cut into ranges; the last text before a word and the first one behind it are its neighbours. A range
    begins with the last text of the ranges before and ends with the first one of those behind."""
    both = texts.select(F.col(text).alias("_t"), F.lit(True).alias("_held")).unionByName(words.select(F.col(word).alias("_t"), F.lit(False).alias("_held")))
    ranged = both.withColumn("_range", range_of(both, "_t"))
    edges = ranged.where("_held").groupBy("_range").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    of = ranged.select("_range").distinct().join(edges, "_range", "left")  # one row a range
    # What comes behind is what comes before in the order turned round: frames that only grow are read once.
    nearest = lambda c, window: F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    around = of.select("_range", nearest("_last", Window.orderBy("_range")).alias("_before"), nearest("_first", Window.orderBy(F.desc("_range"))).alias("_behind"))
    own, inner = F.when(F.col("_held"), F.col("_t")), Window.partitionBy("_range")
    low = F.coalesce(nearest(own, inner.orderBy("_t", F.desc("_held"))), F.col("_before"))  # an equal text stands before the word
    high = F.coalesce(nearest(own, inner.orderBy(F.desc("_t"), "_held")), F.col("_behind"))
    placed = ranged.join(around, "_range").withColumn("_low", low).withColumn("_high", high).where("not _held")
    shared = F.greatest(*(F.coalesce(common_length(F.col("_t"), F.col(c)), F.lit(0)) for c in ("_low", "_high")))
    return placed.select(F.col("_t").alias(word), shared.alias("n"))
