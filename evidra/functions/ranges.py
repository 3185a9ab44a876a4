"""Running numbers and sums over all rows without one task that orders them: values are cut into ranges first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; and values looked at for each cut.
RANGE_ROWS, CUT_SAMPLE = 500_000, 20


def range_of(df: DataFrame, column: str) -> Column:
    """Number of the range that ``column`` falls into. Cuts lie between values that their hash picks, a few for every ``RANGE_ROWS`` rows
    (these few come to the driver), so they are the same whenever the plan runs and follow how the values lie."""
    n = -(-df.count() // RANGE_ROWS)
    if n < 2:
        return F.lit(0)
    share = max(1, RANGE_ROWS // CUT_SAMPLE)
    some = [r[0] for r in df.where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(share)) == 0)).select(column).distinct().orderBy(column).collect()]
    cuts = some[:: max(1, len(some) // n)]
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(column))), F.lit(0)) if cuts else F.lit(0)


def numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` with ``number``: its rows from 1 within ``by``, by ``order`` (distinct there)."""
    ranged = df.withColumn("_range", range_of(df, order))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_before", before).drop("_n")  # one row a range
    number = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order)) + F.col("_before")
    return ranged.join(placed, [*by, "_range"]).withColumn("number", number).drop("_range", "_before")


def running_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` with ``so_far``: the sum of ``value`` up to and with each row, by ``order``."""
    ranged = df.withColumn("_range", range_of(df, order))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("_before", before).drop("_s")  # one row a range
    so_far = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    return ranged.join(F.broadcast(placed), "_range").withColumn("so_far", so_far).drop("_range", "_before")


def islands(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """``df`` with ``island`` (from 1, within ``by``, in order): intervals that a chain of overlaps connects are in one. Furthest ends and counts are
    carried over ranges of starts, so no task sweeps all rows."""
    ranged = df.withColumn("_range", range_of(df, start))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*by, "_range").orderBy(start, end)
    tops = ranged.groupBy(*by, "_range").agg(F.max(end).alias("_top")).withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    reach = F.greatest(F.col("_before"), F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    begun = ranged.join(tops, [*by, "_range"]).withColumn("_new", F.coalesce((F.col(start) > reach).cast("long"), F.lit(1)))
    counts = begun.groupBy(*by, "_range").agg(F.sum("_new").alias("_n")).withColumn("_sum", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    number = F.sum("_new").over(inner.rangeBetween(Window.unboundedPreceding, 0)) + F.col("_sum")  # equal intervals count together, in whichever order they come
    return begun.join(counts, [*by, "_range"]).withColumn("island", number).drop("_range", "_before", "_new", "_sum")
