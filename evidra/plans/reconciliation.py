"""Queries on reconciliation, and the flagship."""

from pyspark.sql import functions as F

from evidra.operators import aggregate as A
from evidra.operators import confidence as G
from evidra.operators import reconcile as R
from evidra.operators.aggregate import Condition as C
from evidra.operators.aggregate import Metric as M
from evidra.operators.aggregate import exact_sum
from evidra.plans.aggregation import SUM
from evidra.plans.base import query

CUT = "1997-09-20"
SIDES = f"""l AS (SELECT team, {SUM('amount')} AS total FROM fx_ledger WHERE sale_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30' GROUP BY team), s AS (SELECT team, {SUM('amount')} AS total FROM fx_summary GROUP BY team),
c AS (SELECT team, s.total AS value_a, l.total AS value_b, l.total - s.total AS diff, abs(l.total - s.total) / greatest(abs(s.total), abs(l.total), 1e-9) AS relative FROM s JOIN l USING (team)),
r AS (SELECT *, relative <= 0.01 AS same, row_number() OVER (ORDER BY value_a DESC, team) AS rank_a, row_number() OVER (ORDER BY value_b DESC, team) AS rank_b FROM c)"""


def _quarter(t):
    return A.where(t("fx_ledger"), [C("sale_date", "between", ("1997-07-01", "1997-09-30"))])


def _sides(t):
    total = [M("sum", "amount", "total")]
    return A.aggregate(t("fx_summary"), total, ("team",)), A.aggregate(_quarter(t), total, ("team",))


def _compared(t):
    return R.compare_results(*_sides(t), "team", "total")


@query("compare_results", "fx_summary", f"WITH {SIDES} SELECT team, value_a, value_b, diff, relative, same FROM r")
def _(t):
    return _compared(t)


@query("only_one_side", "fx_ledger", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM fx_ledger WHERE yr = 1995), b AS (SELECT DISTINCT l_partkey AS k FROM fx_ledger WHERE yr = 1996 AND flag = 'N') SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'b' ELSE 'a' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def _(t):
    keys = lambda rows: rows.select(F.col("l_partkey").alias("k")).distinct()
    return R.only_one_side(keys(t("fx_ledger").where("yr = 1995")), keys(t("fx_ledger").where("yr = 1996 and flag = 'N'")), "k")


@query("rank_change", "fx_summary", f"WITH {SIDES} SELECT team, value_a, value_b, diff, relative, same, rank_a, rank_b, rank_a <> rank_b AS rank_changed FROM r")
def _(t):
    return R.rank_change(_compared(t), "team")


@query("unit_suspect", "fx_summary", f"WITH {SIDES} SELECT max(rel) > 0.5 AND bool_or(near) AS unit_suspect FROM (SELECT rel, greatest(b, a) / least(a, b) BETWEEN 950 AND 1050 AS near FROM (SELECT max(abs(value_b - round(value_a / 1000, 2)) / value_b) AS rel, {SUM('abs(round(value_a / 1000, 2))')} AS a, {SUM('abs(value_b)')} AS b FROM r) x) y")
def _(t):
    a, b = _sides(t)
    return R.unit_suspect(R.compare_results(a.withColumn("total", F.round(F.col("total") / 1000, 2)), b, "team", "total"))


PAIR = """p AS (SELECT a.p_brand AS table_a, b.p_brand AS table_b, length(a.p_brand) % 2 = 0 AS axis_a, substr(b.p_brand, 8, 1) IN ('1', '2') AS axis_b, substr(a.p_brand, 7, 1) AS family_a, substr(b.p_brand, 7, 1) AS family_b, CASE WHEN substr(b.p_brand, 8, 1) = '5' THEN '납품실적' WHEN substr(b.p_brand, 8, 1) = '4' THEN '목표' ELSE '매출실적' END AS metric_b, substr(a.p_brand, 8, 1) = '3' AS excerpt_a FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand <= b.p_brand)"""


@query("independence", "", f"WITH {PAIR} SELECT table_a, table_b, CASE WHEN table_a = table_b THEN 'same_table' WHEN NOT axis_a AND NOT axis_b AND family_a <> family_b THEN 'base_dates_differ' WHEN metric_b <> '매출실적' AND metric_b <> '납품실적' THEN 'metrics_differ' WHEN family_a = family_b THEN 'same_family' WHEN excerpt_a THEN 'excerpt' ELSE 'independent' END AS verdict FROM p")
def _(t):
    brand = t("part").select("p_brand").distinct()
    side = lambda metric, axis, excerpt: F.struct(F.col("p_brand").alias("table_id"), axis.alias("has_axis"), F.substring("p_brand", 7, 1).alias("base_date"), metric.alias("metric"), F.substring("p_brand", 7, 1).alias("family"), F.lit("d").alias("dept"), excerpt.alias("excerpt"))
    last = F.substring("p_brand", 8, 1)
    x = brand.select(side(F.lit("매출실적"), F.length("p_brand") % 2 == 0, last == "3").alias("x"))
    y = brand.select(side(F.when(last == "5", "납품실적").when(last == "4", "목표").otherwise("매출실적"), last.isin("1", "2"), F.lit(False)).alias("y"))
    return R.independence(x.join(y, F.col("x.table_id") <= F.col("y.table_id"))).select(F.col("x.table_id").alias("table_a"), F.col("y.table_id").alias("table_b"), "verdict")


@query("related_metrics", "", f"WITH {PAIR} SELECT table_a, table_b, metric_b = '납품실적' AS related FROM p")
def _(t):
    brand = t("part").select("p_brand").distinct()
    last = F.substring("b", 8, 1)
    pairs = brand.select(F.col("p_brand").alias("a")).join(brand.select(F.col("p_brand").alias("b")), F.col("a") <= F.col("b"))
    named = pairs.select(F.col("a").alias("table_a"), F.col("b").alias("table_b"), F.lit("매출실적").alias("ma"), F.when(last == "5", "납품실적").when(last == "4", "목표").otherwise("매출실적").alias("mb"))
    return named.select("table_a", "table_b", R.related("ma", "mb").alias("related"))


@query("min_rank_items", "", "SELECT c_mktsegment, count(*) AS items, count(*) >= 3 AS rankable FROM customer GROUP BY c_mktsegment")
def _(t):
    return R.min_rank_items(t("customer"), ("c_mktsegment",))


@query("cross_summary", "fx_summary", f"WITH {SIDES} SELECT bool_and(same) AS matched, bool_or(rank_a <> rank_b) AS rank_changed, max(relative) AS max_rel, (SELECT CASE WHEN a <> b THEN concat('summary ', CAST(a AS VARCHAR), ' vs ledger ', CAST(b AS VARCHAR)) END FROM (SELECT max(sale_date) AS a FROM fx_summary) x, (SELECT max(sale_date) AS b FROM fx_ledger WHERE sale_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30') y) AS date_gap FROM r")
def _(t):
    days = t("fx_summary").agg(F.max("sale_date").alias("day_a")).crossJoin(_quarter(t).agg(F.max("sale_date").alias("day_b")))  # one row
    ranked = R.rank_change(_compared(t), "team").crossJoin(F.broadcast(days))
    return R.cross_summary(ranked, gap=R.date_gap(F.lit("summary"), F.col("day_a"), F.lit("ledger"), F.col("day_b")))


LATE = f"SELECT team, count(*) AS late_count, {SUM('amount')} AS late_sum, min(sale_date) AS first_day, max(sale_date) AS last_day FROM fx_ledger WHERE sale_date > DATE '{CUT}' AND sale_date <= DATE '1997-09-30' GROUP BY"


@query("trace_difference", "fx_ledger", f"{LATE} ROLLUP (team)", dates="first_day last_day")
def _(t):
    return R.trace_difference(_quarter(t), "sale_date", F.lit(CUT).cast("date"), "team", "amount")


@query("extract_figures", "fx_texts", "SELECT id, array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '\\d{4}\\s*[-./]\\s*\\d{1,2}\\s*[-./]\\s*\\d{1,2}|\\d{1,2}\\s*/\\s*\\d{1,2}|\\d{4}\\.\\d{1,2}', ' ', 'g'), '[A-Za-z]+\\d[\\w-]*|\\d{3}-\\d{2}-\\d{5}', ' ', 'g'), '\\d[\\d,]*(?:\\.\\d+)?\\s*(?:억원|억|만원|천원|만|원|%)?'), lambda w: regexp_matches(w, '[억만천원%]$') OR contains(w, '.')), lambda w: round(CAST(replace(regexp_extract(w, '^\\d[\\d,]*(?:\\.\\d+)?'), ',', '') AS DOUBLE), 4)))), lambda x: printf('%.4f', x)), ';') AS figures FROM fx_texts")
def _(t):
    return t("fx_texts").select("id", F.array_join(F.transform(R.extract_figures(F.col("text")), lambda x: F.format_string("%.4f", x)), ";").alias("figures"))


@query("number_check", "fx_summary", f"WITH {SIDES} SELECT team AS answer_id, round(CAST(printf('%.2f', value_b / 1e4 * 1.01) AS DOUBLE), 4) AS figure FROM r WHERE rank_a % 5 = 0")
def _(t):
    ranked = R.rank_change(_compared(t), "team")
    shown = F.format_string("%.2f", F.col("value_b") / 1e4 * F.when(F.col("rank_a") % 5 == 0, 1.01).otherwise(1.0))
    answers = ranked.select(F.col("team").alias("answer_id"), F.concat(F.lit("매출 "), shown, F.lit("만원")).alias("text"))
    values = ranked.select(F.col("team").alias("answer_id"), (F.round(F.col("value_b") / 1e4, 2) * 1e4).alias("value"))
    return R.number_check(answers, values)


@query("period_claim", "", "SELECT o_custkey AS answer_id FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders WHERE o_orderdate >= DATE '1995-06-15' AND o_orderdate <= DATE '1995-10-15' GROUP BY o_custkey) g WHERE (lo < DATE '1995-07-01' OR hi > DATE '1995-09-30') AND o_custkey % 4 = 0")
def _(t):
    """Every fourth answer names one period and quotes its figure; the others name two, none, or quote another figure."""
    some = t("orders").where("o_orderdate >= '1995-06-15' and o_orderdate <= '1995-10-15'").groupBy(F.col("o_custkey").alias("answer_id")).agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"), exact_sum(F.col("o_totalprice")).alias("v"))
    shown = A.display_value(F.col("v") + 1, F.lit(True))
    k = F.col("answer_id") % 4
    period = F.when(k == 1, "1995년 3분기와 하반기").when(k == 2, "1995년 매출").otherwise("1995년 3분기 (9월 30일 기준)")
    answers = some.select("answer_id", F.concat(period, F.lit(" 매출은 "), F.when(k == 3, F.lit("0.5%")).otherwise(shown), F.lit(" 입니다")).alias("text"))
    queries = some.select("answer_id", F.array(shown).alias("shown"), "start", "end", F.lit(None).cast("array<string>").alias("months"))
    return R.period_claim(answers, queries, F.lit(1995))


@query("flagship_reconcile", "fx_summary", f"WITH {SIDES}, late AS ({LATE} team), f AS (SELECT max(relative) AS max_rel, bool_or(rank_a <> rank_b) AS changed, bool_and(same) AS matched FROM r) SELECT r.team, value_a, value_b, relative, rank_a, rank_b, rank_a <> rank_b AS rank_changed, coalesce(late_count, 0) AS late_count, coalesce(late_sum, 0) AS late_sum, CASE WHEN f.changed OR (NOT f.matched AND f.max_rel > 0.05) THEN '낮음' WHEN NOT f.matched THEN '보통' ELSE '높음' END AS grade FROM r LEFT JOIN late USING (team) CROSS JOIN f")
def _(t):
    """Do a summary and its ledger rank nations alike, and if not, which late rows explain it?"""
    ranked = R.rank_change(_compared(t), "team")
    late = R.trace_difference(_quarter(t), "sale_date", F.lit(CUT).cast("date"), "team", "amount").where("team is not null")
    facts = R.cross_summary(ranked).select(F.lit(1).alias("answer_id"), F.lit(True).alias("compared"), "matched", "rank_changed", "max_rel", F.lit(True).alias("traced"))
    grade = G.grade_confidence(G.fact_rules(facts)).select(F.col("grade").alias("_grade"))
    rows = ranked.join(late, "team", "left").select("team", "value_a", "value_b", "relative", "rank_a", "rank_b", "rank_changed", F.coalesce("late_count", F.lit(0)).alias("late_count"), F.coalesce("late_sum", F.lit(0.0)).alias("late_sum"))
    return rows.crossJoin(F.broadcast(grade)).withColumnRenamed("_grade", "grade")  # one grade for the comparison
