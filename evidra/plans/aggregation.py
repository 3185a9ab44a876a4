"""Queries on guarded aggregation."""

from pyspark.sql import functions as F

from evidra.operators import aggregate as A
from evidra.operators.aggregate import Condition as C
from evidra.operators.aggregate import Metric as M
from evidra.operators.axes import double_count_guard
from evidra.plans.base import query
from evidra.plans.catalog import AXES, OVERLAP, axes

SUM = "CAST(sum(CAST({} AS DECIMAL(18, 2))) AS DOUBLE)".format
LEDGER = ("team", "sale_date", "amount")


@query("filter_compare", "fx_ledger", f"SELECT team, count(*) AS n, {SUM('amount')} AS total FROM fx_ledger WHERE qty >= 25 AND flag <> 'N' AND sale_date < DATE '1997-01-01' GROUP BY team")
def _(t):
    return A.aggregate(A.where(t("fx_ledger"), [C("qty", ">=", "25"), C("flag", "!=", "N"), C("sale_date", "<", "1997-01-01")]), [M("count", None, "n"), M("sum", "amount", "total")], ("team",))


@query("filter_in", "fx_ledger", f"SELECT flag, {SUM('amount')} AS total FROM fx_ledger WHERE team IN ('NATION_3', 'NATION_17') GROUP BY flag")
def _(t):
    return A.aggregate(A.where(t("fx_ledger"), [C("team", "in", ("NATION_3", "NATION_17"))]), [M("sum", "amount", "total")], ("flag",))


@query("filter_between", "fx_ledger", f"SELECT team, {SUM('amount')} AS total FROM fx_ledger WHERE sale_date BETWEEN DATE '1996-02-01' AND DATE '1996-04-30' GROUP BY team")
def _(t):
    return A.aggregate(A.where(t("fx_ledger"), [C("sale_date", "between", ("1996-02-01", "1996-04-30"))]), [M("sum", "amount", "total")], ("team",))


@query("filter_contains", "fx_ledger", "SELECT team, count(*) AS n FROM fx_ledger WHERE contains(team, 'N_1') GROUP BY team")
def _(t):
    return A.aggregate(A.where(t("fx_ledger"), [C("team", "contains", "N_1")]), [M("count", None, "n")], ("team",))


@query("filter_columns", "", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount > l_tax GROUP BY l_returnflag")
def _(t):
    rows = t("lineitem").withColumn("row_kind", F.lit("data"))
    return A.aggregate(A.where(rows, [C("l_discount", ">", value_column="l_tax")]), [M("count", None, "n")], ("l_returnflag",))


@query("exclude_subtotals", "", f"SELECT p_brand, {SUM('p_retailprice')} AS total FROM part GROUP BY p_brand")
def _(t):
    rows = t("part").select("p_brand", "p_retailprice", F.lit("data").alias("row_kind"))
    totals = rows.groupBy("p_brand").agg(A.exact_sum(F.col("p_retailprice")).alias("p_retailprice")).withColumn("row_kind", F.lit("total"))
    return A.aggregate(A.exclude_subtotals(rows.unionByName(totals)), [M("sum", "p_retailprice", "total")], ("p_brand",))


@query("agg_all", "fx_ledger", f"SELECT {SUM('amount')} AS s, {SUM('amount')} / count(amount) AS a, min(sale_date) AS lo, max(sale_date) AS hi, count(*) AS n, count(DISTINCT team) AS d FROM fx_ledger", dates="lo hi")
def _(t):
    return A.aggregate(A.where(t("fx_ledger"), []), [M("sum", "amount", "s"), M("avg", "amount", "a"), M("min", "sale_date", "lo"), M("max", "sale_date", "hi"), M("count", None, "n"), M("count_distinct", "team", "d")])


@query("group_agg", "fx_ledger", f"SELECT team, flag, {SUM('amount')} AS total, count(*) AS n FROM fx_ledger GROUP BY team, flag")
def _(t):
    return A.aggregate(A.where(t("fx_ledger"), []), [M("sum", "amount", "total"), M("count", None, "n")], ("team", "flag"))


@query("top_k", "fx_ledger", f"SELECT team, total, row_number() OVER (ORDER BY total DESC, team) AS rank FROM (SELECT team, {SUM('amount')} AS total FROM fx_ledger GROUP BY team) g ORDER BY total DESC, team LIMIT 5")
def _(t):
    return A.top_k(A.aggregate(A.where(t("fx_ledger"), []), [M("sum", "amount", "total")], ("team",)), "total", ("team",), 5)


@query("group_guard", "", "SELECT count(DISTINCT o_custkey) AS groups_total, count(DISTINCT o_custkey) > 20 AS truncated, count(DISTINCT o_custkey) > 30 AS refused FROM orders")
def _(t):
    return A.group_guard(t("orders").groupBy("o_custkey").count(), None)


UNIT = "CASE regexp_extract({0}, '단위\\s*:\\s*([^,)\\s]+)', 1) WHEN '천원' THEN 1000 WHEN '백만원' THEN 1000000 WHEN '억원' THEN 100000000 ELSE 1 END".format


@query("unit_normalize", "fx_files", f"SELECT path, CAST({UNIT('preamble')} AS BIGINT) AS multiplier FROM fx_files")
def _(t):
    return t("fx_files").select("path", A.unit_multiplier(F.col("preamble")).alias("multiplier"))


@query("money_scale", "fx_files", f"SELECT path, CAST(size AS DOUBLE) * {UNIT('preamble')} AS total, CAST(size AS DOUBLE) AS n FROM fx_files")
def _(t):
    unit, size = A.unit_multiplier(F.col("preamble")), F.col("size").cast("double")
    return t("fx_files").select("path", A.money_scale(F.lit("공급가액"), F.lit("sum"), size, unit).alias("total"), A.money_scale(F.lit("공급가액"), F.lit("count"), size, unit).alias("n"))


@query("union_tables", "fx_ledger", f"SELECT team, CAST(sum(CAST(CASE WHEN yr = 1996 THEN amount * 1000 ELSE amount END AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM fx_ledger WHERE yr IN (1995, 1996) AND flag = 'R' GROUP BY team")
def _(t):
    ledger = t("fx_ledger")
    parts = [(ledger.where("yr = 1995"), F.lit(1)), (ledger.where("yr = 1996"), F.lit(1000))]
    return A.aggregate(A.union_tables(parts, [C("flag", "=", "R")], LEDGER, "amount"), [M("sum", "amount", "total")], ("team",))


@query("double_count_guard", "fx_axis", f"WITH {AXES}, v AS (SELECT a.signature, a.table_id, CASE WHEN EXISTS (SELECT 1 FROM ax b WHERE b.signature = a.signature AND b.table_id <> a.table_id AND {OVERLAP}) THEN 'overlap' WHEN a.stock AND EXISTS (SELECT 1 FROM ax b WHERE b.signature = a.signature AND b.path <> a.path AND (a.kind IS NULL OR b.kind IS NULL)) THEN 'stock' WHEN EXISTS (SELECT 1 FROM ax b WHERE b.signature = a.signature AND b.path <> a.path AND b.base_date = a.base_date AND (a.kind IS NULL OR b.kind IS NULL)) THEN 'same_base_date' ELSE 'ok' END AS verdict FROM ax a) SELECT * FROM v")
def _(t):
    return double_count_guard(axes(t)).select("signature", "table_id", "verdict")


@query("effective_period", "fx_ledger", "SELECT yr, CAST(greatest(lo, DATE '1995-03-01') AS DATE) AS first_day, CAST(least(hi, DATE '1997-05-31') AS DATE) AS last_day, CAST(datediff('day', greatest(lo, DATE '1995-03-01'), least(hi, DATE '1997-05-31')) AS BIGINT) AS span FROM (SELECT yr, min(sale_date) AS lo, max(sale_date) AS hi FROM fx_ledger GROUP BY yr) g", dates="first_day last_day")
def _(t):
    g = t("fx_ledger").groupBy("yr").agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"))
    day = lambda d: F.lit(d).cast("date")
    first, last, span = A.effective_period(F.col("lo"), F.col("hi"), day("1995-03-01"), day("1997-05-31"))
    return g.select("yr", first.alias("first_day"), last.alias("last_day"), span.alias("span"))


@query("merge_periods", "fx_ledger", "SELECT team, array_to_string(list_sort(list(DISTINCT CAST(month(sale_date) AS INT))), ',') AS months, min(sale_date) AS start, max(sale_date) AS end FROM fx_ledger GROUP BY team", dates="start end")
def _(t):
    months = t("fx_ledger").groupBy("team", "yr").agg(F.collect_set(F.month("sale_date")).alias("months"), F.min("sale_date").alias("start"), F.max("sale_date").alias("end"))
    return A.merge_periods(months, "team")


@query("display_value", "fx_ledger", f"SELECT team, CASE WHEN abs(s) >= 1e8 THEN concat(printf('%.2f', s / 1e8), '억') WHEN abs(s) >= 1e4 THEN concat(format('{{:,}}', CAST(round(s / 1e4) AS BIGINT)), '만원') ELSE concat(format('{{:,}}', CAST(round(s) AS BIGINT)), '원') END AS shown, format('{{:,}}', n) AS rows_shown FROM (SELECT team, {SUM('amount')} AS s, count(*) AS n FROM fx_ledger GROUP BY team) g")
def _(t):
    g = A.aggregate(A.where(t("fx_ledger"), []), [M("sum", "amount", "s"), M("count", None, "n")], ("team",))
    return g.select("team", A.display_value(F.col("s"), F.lit(True)).alias("shown"), A.display_value(F.col("n").cast("double"), F.lit(False)).alias("rows_shown"))


@query("result_anomalies", "", "SELECT count(*) = 0 AS empty, coalesce(bool_or(s < 0), false) AS negative FROM (SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS s FROM customer GROUP BY c_nationkey) g")
def _(t):
    rows = t("customer").withColumn("row_kind", F.lit("data"))
    return A.result_anomalies(A.aggregate(A.where(rows, []), [M("sum", "c_acctbal", "s")], ("c_nationkey",)), "s")


@query("rank_intent", "", "SELECT conv_id, turn, coalesce(regexp_matches(text, '(?i)\\d+\\s*(?:위|등)|가장|제일|최고|최대|최저|최소|상위|하위|순위|랭킹|top'), false) AS wants_rank FROM conversations WHERE role = 'user'")
def _(t):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", A.rank_intent(F.col("text")).alias("wants_rank"))
