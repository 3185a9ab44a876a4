"""Queries on evidence, quality rules and confidence."""

from pyspark.sql import functions as F

from evidra.operators import audits as Q
from evidra.operators import confidence as G
from evidra.operators.aggregate import exact_sum
from evidra.plans import catalog
from evidra.plans.aggregation import SUM
from evidra.plans.base import query
from evidra.plans.catalog import FACTS
from evidra.plans.ingest import KEPT

RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in r) + f"', {'LMI'.index(r[2])}, {G.SIGNALS.index(r[1])})" for r in G.RULES) + ") AS v(rule, signal, severity, title, action, severity_rank, signal_rank))"


@query("compress_rows", "fx_ledger", "WITH d AS (SELECT DISTINCT concat(team, '/', CAST(yr AS VARCHAR(9))) AS team, row_no FROM fx_ledger), i AS (SELECT team, row_no, row_no - row_number() OVER (PARTITION BY team ORDER BY row_no) AS g FROM d), r AS (SELECT team, min(row_no) AS a, max(row_no) AS b FROM i GROUP BY team, g), n AS (SELECT team, CASE WHEN a = b THEN CAST(a AS VARCHAR(9)) ELSE concat(CAST(a AS VARCHAR(9)), '-', CAST(b AS VARCHAR(9))) END AS t, row_number() OVER (PARTITION BY team ORDER BY a) AS n FROM r) SELECT team, concat(string_agg(CASE WHEN n <= 6 THEN t END, ', ' ORDER BY n), CASE WHEN max(n) > 6 THEN concat(' 외 ', CAST(max(n) - 6 AS VARCHAR(9)), '곳') ELSE '' END) AS row_text FROM n GROUP BY team")
def _(t):
    return Q.compress_rows(t("fx_ledger_rows").select(F.concat_ws("/", "team", F.col("yr").cast("string")).alias("team"), "row_no"), ["team"])


NULLED = "CASE WHEN o_orderkey % {k} = 0 THEN NULL ELSE o_orderstatus END"


@query("null_audit", "", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 23 = 0 OR o_orderkey % 31 = 0) AS nulls, CASE WHEN count(*) FILTER (WHERE o_orderkey % 23 = 0 OR o_orderkey % 31 = 0) / count(*) >= 0.05 THEN 'D1H' ELSE 'D1' END AS rule FROM orders GROUP BY o_orderpriority HAVING count(*) FILTER (WHERE o_orderkey % 23 = 0 OR o_orderkey % 31 = 0) > 0")
def _(t):
    key = F.col("o_orderkey")
    rows = t("orders").select("o_orderpriority", F.when(key % 23 != 0, F.col("o_orderstatus")).alias("a"), F.when(key % 31 != 0, F.col("o_totalprice")).alias("b"))
    return Q.null_audit(rows, ["o_orderpriority"], ["a", "b"])


@query("duplicate_audit", "fx_part_rows", f"WITH g AS (SELECT sheet, p_partkey, p_retailprice AS v, count(*) AS n FROM fx_part_rows GROUP BY sheet, p_partkey, p_name, p_size, p_retailprice), s AS (SELECT sheet, CAST(sum(n - 1) AS BIGINT) AS extra_rows, {SUM('v * (n - 1)')} AS extra_sum, {SUM('v * n')} AS total FROM g GROUP BY sheet) SELECT *, CASE WHEN abs(extra_sum) >= 0.01 * abs(total) THEN 'D2H' ELSE 'D2' END AS rule FROM s WHERE extra_rows > 0")
def _(t):
    return Q.duplicate_audit(t("fx_part_rows"), ["sheet"], ["sheet", "p_partkey", "p_name", "p_size", "p_retailprice"], "p_retailprice")


def _priced(t):
    cells = t("fx_cells").where("col_no in (1, 4) and row_no > 5")
    rows = cells.groupBy("sheet", "row_no").agg(F.max(F.when(F.col("v_text") == "Total", "total")).alias("k"), F.max(F.when(F.col("col_no") == 4, F.col("v_num"))).alias("price"))
    return rows.select("sheet", F.coalesce("k", F.lit("data")).alias("row_kind"), "price")


@query("total_row_audit", "fx_cells", f"WITH r AS (SELECT sheet, row_no, max(CASE WHEN v_text = 'Total' THEN 1 ELSE 0 END) AS k, max(CASE WHEN col_no = 4 THEN v_num END) AS price FROM fx_cells WHERE col_no IN (1, 4) AND row_no > 5 GROUP BY sheet, row_no), s AS (SELECT sheet, {SUM('CASE WHEN k = 0 THEN price END')} AS data_sum, max(CASE WHEN k = 1 THEN price END) AS total_row FROM r GROUP BY sheet) SELECT *, 'D3' AS rule FROM s WHERE total_row IS NOT NULL AND abs(total_row - data_sum) > 0.01 * greatest(abs(data_sum), 1.0)")
def _(t):
    return Q.total_row_audit(_priced(t), ["sheet"], "price")


@query("mixed_column_audit", "fx_cells", f"WITH {KEPT} SELECT sheet, CASE WHEN bool_or(kind = 's') AND bool_or(kind = 'n') THEN 'D4' END AS rule FROM k WHERE row_no > 5 AND col_no = 3 GROUP BY sheet")
def _(t):
    kinds = t("fx_cells").where("row_no > 5 and col_no = 3").groupBy("sheet").agg(F.collect_set("kind").alias("k"))
    mixed = F.when(F.size("k") > 1, F.array(F.lit("size"))).otherwise(F.array().cast("array<string>"))
    return kinds.select("sheet", Q.mixed_column_audit(mixed, F.array(F.lit("size"), F.lit("price"))).alias("rule"))


@query("sheet_flag_audit", "fx_cells", "SELECT sheet, array_to_string(list_filter([CASE WHEN sheet LIKE '%5' THEN 'V11' END, CASE WHEN e > 0 THEN 'D5' END, CASE WHEN n > 40 THEN 'D7' END], lambda r: r IS NOT NULL), ',') AS rules FROM (SELECT sheet, count(*) FILTER (WHERE kind = 'e') AS e, count(DISTINCT row_no) AS n FROM fx_cells GROUP BY sheet) s")
def _(t):
    g = t("fx_cells").groupBy("sheet").agg(F.count_if(F.col("kind") == "e").alias("e"), F.count_distinct("row_no").alias("n"))
    return g.select("sheet", F.array_join(Q.sheet_flag_audit(F.col("sheet").endswith("5"), F.col("e"), F.lit(0), F.col("n") > 40), ",").alias("rules"))


@query("vat_audit", "", "SELECT p_brand, CASE WHEN bool_or(p_size > 45) AND bool_or(p_size < 5) THEN 'D8' END AS rule FROM part GROUP BY p_brand")
def _(t):
    g = t("part").groupBy("p_brand").agg(F.bool_or(F.col("p_size") > 45).alias("a"), F.bool_or(F.col("p_size") < 5).alias("b"))
    named = lambda c, n: F.when(F.col(c), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    return g.select("p_brand", Q.vat_audit(named("a", "합계"), named("b", "공급가액")).alias("rule"))


@query("injection_scan", "fx_texts", "SELECT id, CASE WHEN length(text) > 8 AND regexp_matches(text, '(?i)ignore (all |any )?(previous|prior|above) (instructions|prompts?)|system prompt|api[\\s_-]*key') THEN 'D9' END AS rule FROM fx_texts")
def _(t):
    return t("fx_texts").select("id", Q.injection_scan(F.col("text")).alias("rule"))


@query("cell_address", "", "SELECT p_partkey, concat(CASE WHEN n >= 702 THEN chr(CAST(65 + (n - 702) // 676 AS INT)) ELSE '' END, CASE WHEN n >= 26 THEN chr(CAST(65 + (n // 26 - 1) % 26 AS INT)) ELSE '' END, chr(CAST(65 + n % 26 AS INT)), CAST(p_size AS VARCHAR(9))) AS address FROM (SELECT *, p_partkey % 1000 AS n FROM part) x")
def _(t):
    return t("part").select("p_partkey", Q.cell_address(F.col("p_partkey") % 1000 + 1, F.col("p_size")).alias("address"))


@query("period_coverage", "fx_ledger", "SELECT team, yr, CASE WHEN g > 31 THEN 'P1' WHEN g > 7 THEN 'P1M' END AS rule FROM (SELECT team, yr, greatest(datediff('day', max(sale_date), CAST(concat(CAST(yr AS VARCHAR(9)), '-12-31') AS DATE)), datediff('day', CAST(concat(CAST(yr AS VARCHAR(9)), '-01-01') AS DATE), min(sale_date))) AS g FROM fx_ledger GROUP BY team, yr) x")
def _(t):
    g = t("fx_ledger").groupBy("team", "yr").agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"))
    y = F.col("yr").cast("int")
    return g.select("team", "yr", Q.period_coverage(F.col("lo"), F.col("hi"), F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))).alias("rule"))


@query("month_coverage", "fx_ledger", "SELECT team, yr, flag, CASE WHEN count(DISTINCT month(sale_date)) FILTER (WHERE month(sale_date) BETWEEN 7 AND 9) < 3 THEN 'P1' WHEN max(sale_date) < DATE '2001-12-20' THEN 'P2' END AS rule FROM fx_ledger GROUP BY team, yr, flag")
def _(t):
    label = F.concat(F.month("sale_date").cast("string"), F.lit("월"))
    g = t("fx_ledger").groupBy("team", "yr", "flag").agg(F.collect_set(label).alias("months"), F.max("sale_date").alias("base"))
    return g.select("team", "yr", "flag", Q.month_coverage(F.col("months"), F.array(F.lit("7월"), F.lit("8월"), F.lit("9월")), F.col("base"), F.lit("2001-12-20").cast("date")).alias("rule"))


@query("version_audit", "fx_files", f"WITH {FACTS}, t AS (SELECT family FROM g WHERE fresh = 'ok' GROUP BY family HAVING count(DISTINCT sha256) > 1) SELECT path, CASE WHEN fresh = 'stale' THEN 'V1' WHEN fresh = 'copy' THEN 'V2' WHEN t.family IS NOT NULL AND size % 2 = 0 THEN 'V3F' WHEN t.family IS NOT NULL THEN 'V3' END AS rule FROM g LEFT JOIN t ON g.family = t.family")
def _(t):
    return catalog.files(t).select("path", Q.version_audit(F.col("fresh"), F.col("tie_with").isNotNull(), F.col("size") % 2 == 0).alias("rule"))


@query("late_edit_audit", "fx_files", "SELECT path, CASE WHEN datediff('day', CAST(base_date AS DATE), CAST(mtime AS DATE)) + doc_id % 30 > 14 THEN 'V4' END AS rule FROM fx_files")
def _(t):
    return t("fx_files").select("path", Q.late_edit_audit(F.date_add("mtime", (F.col("doc_id") % 30).cast("int")), F.col("base_date")).alias("rule"))


@query("informal_location_audit", "fx_files", "SELECT path, array_to_string(list_filter([CASE WHEN starts_with(path, 'backup/') THEN 'V5' END, CASE WHEN doc_id % 5 = 0 THEN 'V6' END], lambda r: r IS NOT NULL), ',') AS rules FROM fx_files")
def _(t):
    return t("fx_files").select("path", F.array_join(Q.informal_location_audit(F.col("path"), F.when(F.col("doc_id") % 5 == 0, "draft list").otherwise("price list")), ",").alias("rules"))


@query("lock_audit", "fx_files", "SELECT path, 'V7' AS rule, 'kim' AS owner FROM fx_files WHERE doc_id % 9 = 0")
def _(t):
    locks = t("fx_files").where("doc_id % 9 = 0").select("path", F.lit("kim").alias("owner"))
    return Q.lock_audit(t("fx_files").select("path"), locks).select("path", "rule", "owner")


@query("drift_audit", "fx_files", "SELECT path, CASE WHEN doc_id % 8 = 0 THEN 'V9' ELSE 'V8' END AS rule FROM fx_files WHERE doc_id % 8 = 0 OR doc_id % 6 = 1")
def _(t):
    files = t("fx_files")
    now = files.where("doc_id % 8 <> 0").select("path", (F.col("size") + F.when(F.col("doc_id") % 6 == 1, 1).otherwise(0)).alias("size"), "mtime")
    return Q.drift_audit(files.select("path", "size", "mtime"), now)


@query("year_mismatch_audit", "fx_files", "SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'V10' END AS rule FROM fx_files")
def _(t):
    text = F.concat_ws(" ", F.when(F.col("doc_id") % 3 == 0, "plan 2023").when(F.col("doc_id") % 3 == 1, "plan 2024").otherwise("plan"), F.regexp_replace("name", r"\d", ""))
    return t("fx_files").select("path", Q.year_mismatch_audit(text, F.lit(2024)).alias("rule"))


@query("quality_summary", "fx_part_rows", "WITH r AS (SELECT sheet, p_partkey, CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_name END AS name FROM fx_part_rows), d AS (SELECT sheet, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT sheet, count(*) AS n FROM r GROUP BY sheet, p_partkey, name) x GROUP BY sheet) SELECT r.sheet, count(*) AS n, count(*) FILTER (WHERE trim(name) = '') AS blank_name, max(duplicate_rows) AS duplicate_rows FROM r JOIN d USING (sheet) GROUP BY r.sheet")
def _(t):
    rows = t("fx_part_rows").select("sheet", "p_partkey", F.when(F.col("p_partkey") % 41 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    return Q.quality_summary(rows, ["sheet"], ["name"], ["sheet", "p_partkey", "name"])


FIRED = {
    "M1": "unregistered", "M2": "defaulted", "X1": "NOT compared", "X4": "compared AND rank_changed", "X3": "compared AND max_rel > 0.05 AND NOT rank_changed", "X2": "compared AND max_rel > 0.01 AND max_rel <= 0.05 AND NOT rank_changed",
    "X8": "compared AND max_rel > 0.01 AND NOT traced", "X7": "date_gap", "E3": "empty_result", "E4": "negative_sum", "N1": "bad_number", "S1": "NOT has_source",
}
FINDINGS = f"{RULES}, fired AS (" + " UNION ALL ".join(f"SELECT answer_id, '{r}' AS rule FROM fx_facts WHERE {c}" for r, c in FIRED.items()) + "), fd AS (SELECT * FROM fired JOIN rules USING (rule))"
GRADE = "CASE min({}) WHEN 0 THEN '낮음' WHEN 1 THEN '보통' ELSE '높음' END".format


@query("rule_registry", "fx_facts", f"WITH {FINDINGS} SELECT r.rule, r.signal, r.severity, r.title, r.action, count(answer_id) AS findings FROM rules r LEFT JOIN fired f ON r.rule = f.rule GROUP BY ALL")
def _(t):
    """Every registered rule and how many findings it has."""
    fired = G.fact_rules(t("fx_facts")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("findings"))
    return G.rule_registry(t("fx_facts").sparkSession).join(fired, "rule", "left").select("rule", "signal", "severity", "title", "action", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("fact_rules", "fx_facts", f"WITH {FINDINGS} SELECT answer_id, rule FROM fired")
def _(t):
    return G.fact_rules(t("fx_facts")).where("rule is not null")


@query("grade_confidence", "fx_facts", f"WITH {FINDINGS} SELECT f.answer_id, {GRADE('severity_rank')} AS grade FROM fx_facts f LEFT JOIN (SELECT * FROM fd WHERE severity <> 'I') x ON f.answer_id = x.answer_id GROUP BY f.answer_id")
def _(t):
    return G.grade_confidence(G.fact_rules(t("fx_facts")))


@query("signal_grades", "fx_facts", f"WITH {FINDINGS}, s AS (SELECT answer_id, sg.signal FROM fx_facts, (VALUES ('MAP'), ('CROSS'), ('QUAL'), ('EXEC'), ('NUM'), ('EVID')) AS sg(signal)) SELECT s.answer_id, s.signal, {GRADE('severity_rank')} AS grade FROM s LEFT JOIN (SELECT * FROM fd WHERE severity <> 'I') x ON s.answer_id = x.answer_id AND s.signal = x.signal GROUP BY s.answer_id, s.signal HAVING s.signal NOT IN ('NUM', 'EVID') OR min(severity_rank) IS NOT NULL")
def _(t):
    return G.signal_grades(G.fact_rules(t("fx_facts")))


def _listed(text: str, order: str, most: int, source: str) -> str:
    return f"SELECT answer_id, concat(string_agg(CASE WHEN n <= {most} THEN x END, '; ' ORDER BY n), CASE WHEN max(n) > {most} THEN concat(' and ', CAST(max(n) - {most} AS VARCHAR(9)), ' more') ELSE '' END) AS {{}} FROM (SELECT answer_id, {text} AS x, row_number() OVER (PARTITION BY answer_id ORDER BY {order}) AS n FROM {source}) q GROUP BY answer_id"


@query("grade_reason", "fx_facts", f"WITH {FINDINGS}, w AS (SELECT *, min(severity_rank) OVER (PARTITION BY answer_id) AS worst FROM fd WHERE severity <> 'I') {_listed('title', 'signal_rank, rule', 3, 'w WHERE severity_rank = worst').format('reason')}")
def _(t):
    return G.grade_reason(G.fact_rules(t("fx_facts")).where("rule is not null"))


@query("check_message", "fx_facts", f"WITH {FINDINGS}, a AS (SELECT answer_id, action, min(severity_rank * 1000000 + signal_rank * 10000) AS o, min(rule) AS rule FROM fd WHERE severity <> 'I' GROUP BY answer_id, action) {_listed('action', 'o, rule', 4, 'a').format('message')}")
def _(t):
    return G.check_message(G.fact_rules(t("fx_facts")).where("rule is not null"))


def _detailed(t):
    findings = G.fact_rules(t("fx_facts")).where("rule in ('M1', 'M2', 'N1')").withColumn("path", F.concat(F.lit("f"), (F.col("answer_id") % 4).cast("string"))).withColumn("sheet", F.lit("s")).withColumn("row_text", F.lit("1-2"))
    return G.render_findings(findings.withColumn("detail", F.create_map(F.lit("terms"), F.col("path"))), "detail").select("answer_id", "rule", "path", "sheet", "row_text", "shown")


SHOWN = f"{FINDINGS}, sh AS (SELECT answer_id, rule, concat('f', CAST(answer_id % 4 AS VARCHAR(9))) AS path, CASE rule WHEN 'M1' THEN concat('Terms are in no dictionary: f', CAST(answer_id % 4 AS VARCHAR(9))) WHEN 'M2' THEN 'A default was applied: ?' ELSE 'A figure in the answer is in no result' END AS shown FROM fd WHERE rule IN ('M1', 'M2', 'N1'))"


@query("render_findings", "fx_facts", f"WITH {SHOWN} SELECT answer_id, rule, shown FROM sh")
def _(t):
    return _detailed(t).select("answer_id", "rule", "shown")


@query("dedupe_findings", "fx_facts", f"WITH {SHOWN} SELECT DISTINCT rule, path, shown FROM sh")
def _(t):
    return G.dedupe_findings(_detailed(t)).select("rule", "path", "shown")


@query("group_warnings", "fx_facts", f"WITH {SHOWN} SELECT rule, shown, array_to_string(list_sort(list(DISTINCT concat(path, '!s'))), ';') AS places, count(*) AS n FROM sh GROUP BY rule, shown")
def _(t):
    return G.group_warnings(_detailed(t))


@query("no_data_grade", "fx_facts", "SELECT answer_id, CASE WHEN NOT has_source THEN '보통' END AS grade, CASE WHEN NOT has_source THEN 'S2' END AS rule FROM fx_facts")
def _(t):
    grade, rule = G.no_data_grade(F.col("has_source"))
    return t("fx_facts").select("answer_id", grade.alias("grade"), rule.alias("rule"))


@query("answer_type", "fx_facts", "SELECT answer_id, CASE WHEN NOT has_source THEN 'no_data' WHEN traced AND NOT compared THEN 'find' WHEN compared AND date_gap THEN 'verify' ELSE 'compute' END AS kind FROM fx_facts")
def _(t):
    return t("fx_facts").select("answer_id", G.answer_type(F.col("traced"), F.col("compared"), F.col("has_source"), F.col("date_gap")).alias("kind"))


@query("dedupe_sources", "fx_files", "SELECT path, count(*) AS n FROM (SELECT DISTINCT path, role FROM (SELECT path, 'main' AS role FROM fx_files WHERE doc_id % 2 = 0 UNION ALL SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'main' ELSE 'search' END FROM fx_files WHERE doc_id % 3 = 0) x) y GROUP BY path")
def _(t):
    files = t("fx_files")
    row = lambda df, role: df.select("path", F.lit("s").alias("sheet"), F.lit("1").alias("row_text"), role.alias("role"))
    parts = [row(files.where("doc_id % 2 = 0"), F.lit("main")), row(files.where("doc_id % 3 = 0"), F.when(F.col("doc_id") % 4 == 0, "main").otherwise("search"))]
    return G.dedupe_sources(parts).groupBy("path").agg(F.count("*").alias("n"))
