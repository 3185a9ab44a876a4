"""Guarded aggregation of typed tables: conditions, metrics, ranks, units, periods.

A table is a DataFrame with ``row_kind`` and its typed columns; only data rows count. Guards on names and types raise before any
plan is built; guards that need data are columns of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier, money and stock columns, units, words that ask for a rank.
ID_COLUMNS = ("전표번호", "원전표번호", "사업자번호", "수주번호", "발주번호", "계약번호", "No")
MONEY_COLUMNS = ("매출실적", "목표", "공급가액", "부가세", "합계", "단가", "금액", "계약금액", "당월발생", "당월입금", "당월잔액", "전월잔액")
STOCK_COLUMNS = ("기말재고", "기초재고", "안전재고", "전월잔액", "당월잔액")
UNITS = {"천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000}
RANK_WORDS = r"(?i)\d+\s*(?:위|등)|가장|제일|최고|최대|최저|최소|상위|하위|순위|랭킹|top"
DEFAULT_LIMIT, MOST_GROUPS, MOST_TABLES = 20, 30, 40
AGGREGATES = ("sum", "avg", "min", "max", "count", "count_distinct")


class Refused(ValueError):
    """A query that must not run as asked."""


@dataclass(frozen=True)
class Condition:
    """``column op value``; ``op`` is a comparison, in (values), between (two values) or contains; or another column's value."""

    column: str
    op: str
    value: object = None
    value_column: str | None = None


@dataclass(frozen=True)
class Metric:
    agg: str
    column: str | None
    alias: str


def exact_sum(x: Column) -> Column:
    """A sum of amounts with two decimals that doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def exclude_subtotals(df: DataFrame) -> DataFrame:
    return df.where(F.col("row_kind") == "data")


def condition(df: DataFrame, c: Condition) -> Column:
    if c.column not in df.columns:
        raise Refused(f"no column {c.column}")
    left, kind = F.col(c.column), df.schema[c.column].dataType
    typed = lambda v: F.lit(v).cast(kind)
    compare = {"=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}
    if c.value_column is not None:
        if c.value_column not in df.columns or type(df.schema[c.value_column].dataType) is not type(kind):
            raise Refused(f"{c.value_column} can't be compared with {c.column}")
        return compare[c.op](left, F.col(c.value_column))
    if c.op in compare:
        return compare[c.op](left, typed(c.value))
    if c.op == "in":
        return left.isin(*(typed(v) for v in c.value))
    if c.op == "between":
        return left.between(*(typed(v) for v in c.value))
    if c.op == "contains":
        return left.cast("string").contains(str(c.value))
    raise Refused(f"no operator {c.op}")


def where(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Data rows that meet all conditions."""
    return reduce(lambda d, c: d.where(condition(df, c)), conditions, exclude_subtotals(df))


def aggregate(df: DataFrame, metrics: list[Metric], group_by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics by group. Refuses unknown and identifier group columns, and sums or means of what is no number."""
    for g in group_by:
        if g not in df.columns or g in ID_COLUMNS:
            raise Refused(f"can't group by {g}")
    out = []
    for m in metrics:
        if m.agg not in AGGREGATES or (m.column is None and m.agg != "count") or (m.column and m.column not in df.columns):
            raise Refused(f"no metric {m.agg}({m.column})")
        if m.agg in ("sum", "avg") and not isinstance(df.schema[m.column].dataType, T.NumericType):
            raise Refused(f"{m.column} is no number")
        x = F.col(m.column) if m.column else F.lit(1)
        whole = m.column and isinstance(df.schema[m.column].dataType, T.IntegralType)
        made = {"sum": lambda: F.sum(x.cast("decimal(38,0)")).cast("long") if whole else exact_sum(x), "avg": lambda: F.sum(x.cast("decimal(18,2)")).cast("double") / F.count(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "count": lambda: F.count(x), "count_distinct": lambda: F.count_distinct(x)}
        out.append(made[m.agg]().alias(m.alias))
    return df.groupBy(*group_by).agg(*out)


def top_k(groups: DataFrame, metric: str, keys: tuple[str, ...], limit: int = DEFAULT_LIMIT, descending: bool = True) -> DataFrame:
    """The first ``limit`` (at most 30) groups by ``metric``, ties by keys; ``rank`` counts from 1, null when ascending."""
    limit = min(limit, MOST_GROUPS)
    order = [F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric), *(F.asc_nulls_last(k) for k in keys)]
    top = groups.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order)).cast("long")  # at most 30 rows are left
    return top.withColumn("rank", rank if descending else F.lit(None).cast("long"))


def group_guard(groups: DataFrame, limit: int | None) -> DataFrame:
    """How many groups there are, whether the answer is cut, and whether it is refused for want of a limit."""
    return groups.agg(F.count("*").alias("groups_total")).select(
        "groups_total",
        (F.col("groups_total") > (limit or DEFAULT_LIMIT)).alias("truncated"),
        F.lit(limit is None).__and__(F.col("groups_total") > MOST_GROUPS).alias("refused"),
    )


def unit_multiplier(preamble: Column) -> Column:
    """What a sheet's numbers are multiplied by, from the unit in its preamble."""
    unit = F.regexp_extract(preamble, r"단위\s*:\s*([^,)\s]+)", 1)
    return reduce(lambda done, u: done.when(unit == u[0], u[1]), list(UNITS.items())[1:], F.when(unit == "천원", UNITS["천원"])).otherwise(1).cast("long")


def is_money(column: Column) -> Column:
    return column.isin(*MONEY_COLUMNS) | column.endswith("납품실적")


def money_scale(column: Column, agg: Column, value: Column, multiplier: Column) -> Column:
    """Sums, means and extremes of money columns in single units; counts as they are."""
    return F.when(is_money(column) & ~agg.isin("count", "count_distinct"), value * multiplier).otherwise(value)


def union_tables(parts: list[tuple[DataFrame, Column]], conditions: list[Condition], keep: tuple[str, ...], amount: str) -> DataFrame:
    """Rows of same-layout tables under one another: each part is filtered, cut to ``keep`` and put on its own unit first."""
    if len(parts) > MOST_TABLES:
        raise Refused("too many tables")
    each = [where(df, conditions).select(*(k for k in keep if k != amount), (F.col(amount) * unit).alias(amount)) for df, unit in parts]
    return reduce(DataFrame.unionByName, each)


def effective_period(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """A table's date range cut by a query's bounds: first day, last day, days between."""
    first, last = F.greatest(start, low), F.least(end, high)
    return first, last, F.datediff(last, first).cast("long")


def merge_periods(periods: DataFrame, by: str) -> DataFrame:
    """Per ``by``: the months of all periods in order if each has months, else the earliest start and the latest end."""
    months = F.array_sort(F.array_distinct(F.flatten(F.collect_list("months"))))
    return periods.groupBy(by).agg(F.when(F.bool_and(F.col("months").isNotNull()), F.array_join(months.cast("array<string>"), ",")).alias("months"), F.min("start").alias("start"), F.max("end").alias("end"))


def display_value(x: Column, money: Column) -> Column:
    """Money in hundred-millions, ten-thousands or units; other numbers with separators."""
    won = F.when(F.abs(x) >= 1e8, F.concat(F.format_string("%.2f", x / 1e8), F.lit("억"))).when(F.abs(x) >= 1e4, F.concat(F.format_number(F.round(x / 1e4), 0), F.lit("만원"))).otherwise(F.concat(F.format_number(F.round(x), 0), F.lit("원")))
    plain = F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(F.round(x, 2), 2))
    return F.coalesce(F.when(money, won).otherwise(plain), F.lit("-"))


def result_anomalies(groups: DataFrame, metric: str) -> DataFrame:
    """Whether a result is empty, and whether it has a negative sum."""
    return groups.agg((F.count("*") == 0).alias("empty"), F.coalesce(F.bool_or(F.col(metric) < 0), F.lit(False)).alias("negative"))


def rank_intent(text: Column) -> Column:
    return F.coalesce(text.rlike(RANK_WORDS), F.lit(False))
