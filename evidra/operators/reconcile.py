"""Comparing two independent results: differences, missing keys, ranks, units, and the rows that explain a difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.aggregate import exact_sum
from evidra.operators.terms import parse_period

SAME, LARGE = 0.01, 0.05
# Metrics that record one thing at different points, factors of units, marks of excerpts, least items of a ranking.
RELATED_METRICS = (("매출실적", "납품실적"),)
UNIT_FACTORS = (1e3, 1e4, 1e6, 1e8)
EXCERPT = "발췌|복사|인용|재편집"
LEAST_RANKED = 3


def joined_key(*keys: Column) -> Column:
    return F.concat_ws(" / ", *(F.coalesce(k.cast("string"), F.lit("None")) for k in keys))


def compare_results(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Common keys: both values (null as 0), difference, relative difference and whether that is at most 1 %."""
    va, vb = F.coalesce(F.col("x." + value), F.lit(0.0)), F.coalesce(F.col("y." + value), F.lit(0.0))
    both = a.alias("x").join(b.alias("y"), key).select(F.col(key), va.alias("value_a"), vb.alias("value_b"))
    diff = F.col("value_b") - F.col("value_a")
    relative = F.abs(diff) / F.greatest(F.abs("value_a"), F.abs("value_b"), F.lit(1e-9))
    return both.select(key, "value_a", "value_b", diff.alias("diff"), relative.alias("relative"), (relative <= SAME).alias("same"))


def only_one_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, and which has them."""
    x, y = a.select(key, F.lit(1).alias("in_a")), b.select(key, F.lit(1).alias("in_b"))
    return x.join(y, key, "full_outer").where("in_a is null or in_b is null").select(key, F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))


def rank_change(compared: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks of both values within ``by`` (ties by key) and whether they differ."""
    rank = lambda v: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(v), key)).cast("long")
    return compared.withColumn("rank_a", rank("value_a")).withColumn("rank_b", rank("value_b")).withColumn("rank_changed", F.col("rank_a") != F.col("rank_b"))


def unit_suspect(compared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether totals differ by nearly a unit factor: largest relative difference over 0.5, ratio within 5 % of a factor."""
    a, b = exact_sum(F.abs("value_a")), exact_sum(F.abs("value_b"))
    sums = compared.groupBy(*by).agg(a.alias("a"), b.alias("b"), F.max("relative").alias("largest"))
    ratio = F.greatest("a", "b") / F.greatest(F.least("a", "b"), F.lit(1e-9))
    near = reduce(Column.__or__, (F.abs(ratio / f - 1) <= 0.05 for f in UNIT_FACTORS))
    return sums.select(*by, ((F.col("largest") > 0.5) & near).alias("unit_suspect"))


def is_excerpt(title: Column) -> Column:
    return F.coalesce(title.rlike(EXCERPT), F.lit(False))


def independence(pairs: DataFrame) -> DataFrame:
    """Verdict on a pair of results; columns x and y are structs of table_id, has_axis, base_date, metric, family, dept, excerpt."""
    x, y = "x.", "y."
    same = lambda c: F.col(x + c) == F.col(y + c)
    verdict = (
        F.when(same("table_id"), "same_table")
        .when(~F.col("x.has_axis") & ~F.col("y.has_axis") & ~same("base_date"), "base_dates_differ")
        .when(~same("metric") & ~related("x.metric", "y.metric"), "metrics_differ")
        .when(same("family") & same("dept"), "same_family")
        .when(F.col("x.excerpt") | F.col("y.excerpt"), "excerpt")
        .otherwise("independent")
    )
    return pairs.withColumn("verdict", verdict)


def related(a: str, b: str) -> Column:
    """Different metrics that may be compared with a note."""
    return reduce(Column.__or__, ((F.col(a) != F.col(b)) & F.col(a).isin(*group) & F.col(b).isin(*group) for group in RELATED_METRICS))


def min_rank_items(compared: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Common keys of each comparison, and whether a ranking can be checked on them."""
    return compared.groupBy(*by).agg(F.count("*").alias("items")).withColumn("rankable", F.col("items") >= LEAST_RANKED)


def date_gap(a_name: Column, a_date: Column, b_name: Column, b_date: Column) -> Column:
    """Both sources with their base dates where these differ."""
    return F.when(a_date != b_date, F.concat(F.concat_ws(" ", a_name, a_date.cast("string")), F.lit(" vs "), F.concat_ws(" ", b_name, b_date.cast("string"))))


def cross_summary(ranked: DataFrame, by: tuple[str, ...] = (), gap: Column | None = None) -> DataFrame:
    """Whether all agree, whether ranks changed, the largest relative difference, and the ``gap`` of base dates (one value a group)."""
    gaps = F.max(F.lit(None).cast("string") if gap is None else gap).alias("date_gap")
    return ranked.groupBy(*by).agg(F.bool_and("same").alias("matched"), F.bool_or("rank_changed").alias("rank_changed"), F.max("relative").alias("max_rel"), gaps)


def trace_difference(rows: DataFrame, date: str, cut: Column, group: str, amount: str, multiplier: int = 1) -> DataFrame:
    """Rows dated after the cut-off by group, and in all (group null): count, sum on one unit, first and last day."""
    late = rows.where(F.col(date) > cut)
    return late.rollup(group).agg(F.count("*").alias("late_count"), (exact_sum(F.col(amount)) * multiplier).alias("late_sum"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))


# Dates and identifiers that are no figures, and figures with their units.
# A year with a month is none within a longer number (29374.09) or before a unit (2024.12만원).
DATES = r"\d{4}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{1,2}|\d{1,2}\s*/\s*\d{1,2}|(?<!\d)\d{4}\.\d{1,2}(?!\d|\s*(?:[억만원%]|천원))"
IDS = r"[A-Za-z]+\d[\w-]*|\d{3}-\d{2}-\d{5}"
FIGURE = r"(\d[\d,]*(?:\.\d+)?)\s*(억원|억|만원|천원|만|원|%)?"
SHOWN_FIGURE = r"\d[\d,]*(?:\.\d+)?\s*(?:억원|억|만원|천원|만|원|%)"
NAMED_DAY = r"\d{4}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{1,2}|\d{1,2}\s*월\s*\d{1,2}\s*일"


def extract_figures(text: Column, strict: bool = True) -> Column:
    """Distinct numbers of a text without its dates and identifiers; strict: only those with a unit or a decimal point."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), DATES, " "), IDS, " ")
    whole = F.regexp_extract_all(plain, F.lit(FIGURE), F.lit(0))
    kept = F.filter(whole, lambda w: w.rlike(r"[억만천원%]$") | w.contains(".")) if strict else whole
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.round(F.regexp_replace(F.regexp_extract(w, r"^\d[\d,]*(?:\.\d+)?", 0), ",", "").cast("double"), 4))))


def number_check(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Figures of answers (answer_id, text) that are in none of their results (answer_id, value), nor these over 1e8 or 1e4."""
    figures = answers.select("answer_id", F.explode(extract_figures(F.col("text"))).alias("figure"))
    scaled = F.explode(F.array(F.round("value", 4), F.round(F.col("value") / 1e8, 4), F.round(F.col("value") / 1e4, 4)))
    allowed = results.select("answer_id", scaled.alias("figure")).distinct()
    return figures.join(allowed, ["answer_id", "figure"], "left_anti")


def period_claim(answers: DataFrame, queries: DataFrame, latest_year: Column) -> DataFrame:
    """Answers (answer_id, text) that name exactly one period, days not counted, while a query whose figures they quote (answer_id, shown:
    its displayed values, start, end, months: null for dated tables) covers other days or months."""
    named = F.regexp_replace(F.coalesce("text", F.lit("")), NAMED_DAY, " ")
    label = lambda pattern, unit: F.transform(F.regexp_extract_all(named, F.lit(pattern), F.lit(1)), lambda x: F.concat(x, F.lit(unit)))
    labels = F.array_distinct(F.concat(label(r"([1-4])\s*분기", "분기"), label(r"(?<!\d)(1[0-2]|[1-9])\s*월", "월"), label(r"(상반기|하반기)", "")))
    figures = F.transform(F.regexp_extract_all("text", F.lit(SHOWN_FIGURE), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))
    claims = answers.select("answer_id", figures.alias("figures"), F.size(labels).alias("n"), parse_period(named, latest_year).alias("p")).where("n = 1 and p is not null")
    quoted = claims.join(queries, "answer_id").where(F.arrays_overlap("figures", F.transform("shown", lambda x: F.replace(x, F.lit(" "), F.lit("")))))
    inside = F.when(F.col("months").isNotNull(), F.size(F.array_except("months", "p.months")) == 0).otherwise((F.col("start") >= F.col("p.start")) & (F.col("end") <= F.col("p.end")))
    return quoted.where(~inside).select("answer_id").distinct()
