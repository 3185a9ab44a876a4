"""Time axes of tables: which cover the same time, which may be summed. Everything is in proportion to tables, also where all share one layout.

An axis is a range of dates, a set of months (labels ``7월``, as bits 1 to 12), or unknown. Ranges are swept in order of their first days, by
ranges of days, so no task holds a layout; sets of months are merged by their at most 4096 kinds.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.ranges import islands, range_of
from evidra.functions.storage import stored

# Labels of months, and partners that are listed for a table.
MONTH, MOST_PARTNERS = r"^(1[0-2]|[1-9])월$", 40


def month_bits(labels: Column) -> Column:
    """A set of month labels as bits; null if it is empty or another label is among them."""
    numbers = F.transform(labels, lambda x: F.nullif(F.regexp_extract(x, MONTH, 1), F.lit("")).cast("int"))
    bits = F.aggregate(numbers, F.lit(0), lambda s, m: s.bitwiseOR(F.try_element_at(F.array(*(F.lit(1 << k) for k in range(1, 13))), m)))
    return F.when((F.size(labels) > 0) & ~F.exists(numbers, lambda m: m.isNull()), bits)


def time_axis(rows: DataFrame, by: list[str], date: Column, month: Column) -> DataFrame:
    """``by``, ``kind`` (dates, months or null), ``start`` and ``end`` of the date column, and ``months`` (bits) of the month labels where a table has
    no dates; one pass over the data rows."""
    seen = rows.groupBy(*by).agg(F.min(date).alias("start"), F.max(date).alias("end"), F.collect_set(month).alias("labels"))  # a dozen labels
    dated = F.col("start").isNotNull()
    bits = F.when(~dated, month_bits(F.col("labels")))
    return seen.withColumn("months", bits).withColumn("kind", F.when(dated, "dates").when(F.col("months").isNotNull(), "months")).select(*by, "kind", "start", "end", "months")


def axes_overlap(a: Column, b: Column) -> Column:
    """Whether two axes (structs kind, start, end, months) cover the same time; axes of two kinds, or unknown ones, don't."""
    ranges = (a["kind"] == "dates") & (b["kind"] == "dates") & (a["start"] <= b["end"]) & (b["start"] <= a["end"])
    months = (a["kind"] == "months") & (b["kind"] == "months") & (a["months"].bitwiseAND(b["months"]) != 0)
    return F.coalesce(ranges, F.lit(False)) | F.coalesce(months, F.lit(False))


def _months_together(masks: Column) -> Column:
    """Sets of months merged until none share a month."""
    def add(done: Column, m: Column) -> Column:
        whole = F.aggregate(F.filter(done, lambda d: d.bitwiseAND(m) != 0), m, lambda s, d: s.bitwiseOR(d))
        return F.concat(F.filter(done, lambda d: d.bitwiseAND(m) == 0), F.array(whole))

    return F.aggregate(masks, F.array().cast("array<int>"), add)


def overlap_groups(tables: DataFrame, by: str = "signature") -> DataFrame:
    """``tables`` (by, kind, start, end, months) with ``time_group``: tables of one ``by`` are in one group if a chain of overlapping axes connects them
    (``d`` and a number for dates, ``m`` and the months' bits); null without an axis. And ``group_size``: with more than one, each of
    its tables overlaps another."""
    dated = islands(tables.where("kind = 'dates'"), [by], "start", "end").withColumn("time_group", F.concat(F.lit("d"), F.col("island").cast("string"))).drop("island")
    monthly = tables.where("kind = 'months'")
    masks = monthly.select(by, "months").distinct().groupBy(by).agg(_months_together(F.array_sort(F.collect_list("months"))).alias("_whole"))  # 4096 kinds at most
    met = monthly.join(masks, by).withColumn("time_group", F.concat(F.lit("m"), F.filter("_whole", lambda w: w.bitwiseAND(F.col("months")) != 0)[0].cast("string"))).drop("_whole")
    known = dated.unionByName(met)
    sizes = known.groupBy(by, "time_group").agg(F.count("*").alias("group_size"))
    rest = tables.where("kind is null").withColumn("time_group", F.lit(None).cast("string")).withColumn("group_size", F.lit(None).cast("long"))
    return known.join(sizes, [by, "time_group"]).unionByName(rest)


def double_count_guard(tables: DataFrame, by: str = "signature") -> DataFrame:
    """Verdict on each table (by, table_id, path, kind, start, end, months, base_date, stock) that would be summed with the others of its ``by``:
    ``overlap`` with another's time; without an axis on one side, in another file: ``stock`` for numbers that are states, or
    ``same_base_date``; else ``ok``. A sum is allowed where all its tables are ok. One row a table; no pairs are formed."""
    tables = stored(tables)
    unknown = F.when(F.col("kind").isNull(), F.col("path"))
    edges = lambda p: (F.min("path").alias(f"{p}low"), F.max("path").alias(f"{p}high"), F.min(unknown).alias(f"{p}unknown_low"), F.max(unknown).alias(f"{p}unknown_high"))
    of_all = tables.groupBy(by).agg(*edges("g_"), F.bool_or("stock").alias("g_stock"))
    of_day = tables.where("base_date is not null").groupBy(by, "base_date").agg(*edges("b_"))

    def other_file(p: str) -> Column:
        """Whether there is another file with which one side lacks an axis."""
        differs = lambda low, high: F.coalesce((F.col(low) != F.col("path")) | (F.col(high) != F.col("path")), F.lit(False))
        return F.when(F.col("kind").isNull(), differs(f"{p}low", f"{p}high")).otherwise(differs(f"{p}unknown_low", f"{p}unknown_high"))

    joined = overlap_groups(tables, by).join(of_all, by, "left").join(of_day, [by, "base_date"], "left")
    verdict = F.when(F.col("group_size") > 1, "overlap").when(other_file("g_") & F.col("g_stock"), "stock").when(other_file("b_"), "same_base_date").otherwise("ok")
    return joined.select(by, "table_id", "time_group", verdict.alias("verdict"))


PARTNER = "struct<day:date,id:string>"


def _newest(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` newest tables of each ``by``, as an array of (day, id), newest first."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("data_date"), "table_id"))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("data_date").alias("day"), F.col("table_id").alias("id")))).alias("top"))


def _merged(lists: list, most: int) -> list[dict]:
    """The newest of several lists of (day, id), newest first, ids in order among equal days."""
    every = {x["id"]: x for part in lists if part is not None for x in part}
    return heapq.nsmallest(most, every.values(), key=lambda x: (x["day"] is None, -x["day"].toordinal() if x["day"] is not None else 0, x["id"]))


def _sweep(dated: DataFrame, entry: Column, asked: Column, most: int) -> DataFrame:
    """(signature, table_id, partners): for each table the newest ``most`` tables of its signature whose ``entry`` number is below its ``asked`` number.
    Numbers are cut into ranges; each range begins with the newest of all ranges before, and carries a list of ``most`` on."""
    events = dated.select("signature", "table_id", "data_date", F.explode(F.array(F.struct(F.lit(1).alias("what"), entry.alias("at")), F.struct(F.lit(0).alias("what"), asked.alias("at")))).alias("e")).select("signature", "table_id", "data_date", "e.what", "e.at")
    ranged = events.withColumn("_range", range_of(events, "at"))
    tops = _newest(ranged.where("what = 1"), ["signature", "_range"], most).select("signature", "_range", F.transform("top", lambda x: F.struct(x["day"].alias("day"), x["id"].alias("id"))).alias("top"))

    def carry(group: pd.DataFrame) -> pd.DataFrame:  # one row a range of one signature
        now, out = [], []
        for _, row in group.sort_values("_range").iterrows():
            out.append((row["signature"], row["_range"], now))
            now = _merged([now, row["top"]], most)
        return pd.DataFrame(out, columns=["signature", "_range", "before"])

    ranges = ranged.select("signature", "_range").distinct().join(tops, ["signature", "_range"], "left")
    schema = dated.schema["signature"].dataType.simpleString()
    before = ranges.groupBy("signature").applyInPandas(carry, f"signature {schema}, _range int, before array<{PARTNER}>")

    def run(group: pd.DataFrame) -> pd.DataFrame:  # rows of one range
        now, out = list(group["before"].iloc[0]), []
        for row in group.sort_values(["at", "what", "table_id"]).itertuples():
            if row.what:
                now = _merged([now, [{"day": None if pd.isna(row.data_date) else row.data_date, "id": row.table_id}]], most)
            else:
                out.append((row.signature, row.table_id, now))
        return pd.DataFrame(out, columns=["signature", "table_id", "partners"])

    return ranged.join(before, ["signature", "_range"]).groupBy("signature", "_range").applyInPandas(run, f"signature {schema}, table_id string, partners array<{PARTNER}>")


def same_layout(tables: DataFrame, most: int = MOST_PARTNERS) -> DataFrame:
    """(a, b): for each table (table_id, path, signature, kind, start, end, months, data_date) those it may be summed with: one signature, and either
    one file or known axes that don't overlap; at most ``most`` for each, its own file first, then newest first.

    For ranges of dates, the newest tables that end before a table begins come from one sweep, those that begin after it ends from another; tables
    of two kinds never overlap; sets of months are compared kind by kind. Each source gives no more than ``most`` for a table."""
    tables = stored(tables)
    plain = F.transform("top", lambda x: F.struct(x["day"].alias("day"), x["id"].alias("id")))
    own = _newest(tables, ["signature", "path"], most + 1)
    first = tables.join(own, ["signature", "path"]).select("signature", "table_id", F.lit(True).alias("own"), F.explode(plain).alias("p"))
    dated, monthly = tables.where("kind = 'dates'"), tables.where("kind = 'months'")
    day = F.unix_date
    sweeps = _sweep(dated, day("end"), day("start"), most).unionByName(_sweep(dated, -day("start"), -day("end"), most))
    lists = [sweeps]
    for some, others in ((dated, monthly), (monthly, dated)):
        top = _newest(others, ["signature"], most)
        lists.append(some.join(top, "signature").select("signature", "table_id", plain.alias("partners")))
    sets = _newest(monthly, ["signature", "months"], most)
    x, y = sets.select("signature", "months"), sets.select("signature", F.col("months").alias("other"), "top")
    free = x.join(y, "signature").where(F.col("months").bitwiseAND(F.col("other")) == 0).select("signature", "months", F.explode(plain).alias("p"))  # 4096 kinds of sets at most
    best = free.withColumn("n", F.row_number().over(Window.partitionBy("signature", "months").orderBy(F.desc_nulls_last("p.day"), "p.id"))).where(F.col("n") <= most).groupBy("signature", "months").agg(F.collect_list("p").alias("partners"))
    lists.append(monthly.join(best, ["signature", "months"]).select("signature", "table_id", "partners"))
    apart = lists[0]
    for more in lists[1:]:
        apart = apart.unionByName(more)
    rest = apart.select("signature", "table_id", F.lit(False).alias("own"), F.explode("partners").alias("p"))
    pairs = first.unionByName(rest).where(F.col("p.id") != F.col("table_id")).groupBy("signature", "table_id", F.col("p.id").alias("b")).agg(F.max("own").alias("own"), F.max("p.day").alias("day"))
    n = F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("own"), F.desc_nulls_last("day"), "b"))
    return pairs.withColumn("n", n).where(F.col("n") <= most).select(F.col("table_id").alias("a"), "b")
