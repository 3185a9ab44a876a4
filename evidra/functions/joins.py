"""Joins on "holds as a substring", whichever size the sides have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Needles up to which each is broadcast and looked for in every text; characters of the runs on which texts meet more needles.
FEW, GRAM = 200, 3


def small(df: DataFrame, most: int = FEW) -> bool:
    """Whether a frame has at most ``most`` rows; looks at no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def _runs(text: str, k: int) -> Column:
    """All runs of k characters of a text; none of a shorter one."""
    chars = F.split(text, "")
    found = chars
    for j in range(2, k + 1):
        found = F.zip_with(found, F.slice(chars, F.lit(j), F.length(text)), lambda x, y: F.concat(x, y))  # null where the text has ended
    return F.filter(found, lambda x: x.isNotNull())


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, few: int = FEW) -> DataFrame:
    """All pairs where ``text`` holds ``needle`` literally (no empty needles). Few needles are broadcast. More of them meet the distinct
    texts, as hashes, on the run of three characters (all of a shorter needle) that the fewest texts hold, so common runs gather no
    rows unless a needle has no other; what meets is then compared."""
    needles = needles.where(F.length(needle) > 0)
    hit = F.col(text).contains(F.col(needle))
    if small(needles, few):
        return texts.join(F.broadcast(needles), hit)
    size = F.least(F.length(needle), F.lit(GRAM))
    sizes = [r[0] for r in needles.select(size).distinct().collect()]  # at most GRAM numbers
    runs = F.array_distinct(F.flatten(F.array(*(_runs(text, k) for k in sizes))))
    held = texts.select(text).distinct().select(F.xxhash64(text).alias("_text"), F.explode(runs).alias("_run"))
    often = held.groupBy("_run").agg(F.count("*").alias("_n"))
    own = F.coalesce(*(F.when(size == k, _runs(needle, k)) for k in sizes))
    asked = needles.select(needle).distinct().select(F.col(needle).alias("_needle"), F.explode(F.array_distinct(own)).alias("_run"))
    rarest = asked.join(often, "_run", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("run"))).alias("_least"))
    pairs = held.join(rarest.where("_least.n > 0").select("_needle", F.col("_least.run").alias("_run")), "_run").select("_text", "_needle").distinct()
    met = texts.withColumn("_text", F.xxhash64(text)).join(pairs, "_text").join(needles.withColumn("_needle", F.col(needle)), "_needle")
    return met.where(hit).drop("_text", "_needle")
