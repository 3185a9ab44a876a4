"""Queries on values, terms, periods and scope."""

from pyspark.sql import functions as F

from evidra.functions.grams import read_index, write_index
from evidra.functions.storage import shared_folder
from evidra.operators import search as S
from evidra.operators import terms as T
from evidra.plans.base import query

INDEX = "ix AS (SELECT value, lower(value) AS value_norm, 'customer' AS table_id, c_custkey AS row_no, col AS \"column\" FROM (SELECT c_custkey, c_name AS value, '거래처명' AS col FROM customer UNION ALL SELECT c_custkey, c_mktsegment, '팀명' FROM customer) x WHERE length(value) BETWEEN 2 AND 120)"
TERMS = "tm AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS term_id, CASE r_regionkey WHEN 0 THEN 'building' WHEN 1 THEN '#00000001' WHEN 2 THEN 'no such customer#' WHEN 3 THEN 'customer#' ELSE 'MACHINERY' END AS term FROM region)"


def index(t):
    rows = t("customer").select(F.lit("customer").alias("table_id"), F.col("c_custkey").alias("row_no"), F.col("c_name").alias("거래처명"), F.col("c_mktsegment").alias("팀명"), F.lit("data").alias("row_kind"))
    return S.build_value_index(rows, "table_id", "row_no", ["거래처명", "팀명"])


def stored(t):
    """The index, written with its postings to the shared folder."""
    rows = index(t)
    folder = shared_folder(rows.sparkSession, "index")
    write_index(rows, "value_norm", folder)
    return read_index(rows.sparkSession, folder)


#: Freshness of the one table that is searched, by column.
FRESH = "CASE \"column\" WHEN '팀명' THEN 'stale' ELSE 'ok' END"


def terms(t):
    k = F.col("r_regionkey")
    return t("region").select((k + 1).cast("long").alias("term_id"), F.when(k == 0, "building").when(k == 1, "#00000001").when(k == 2, "no such customer#").when(k == 3, "customer#").otherwise("MACHINERY").alias("term"))


@query("value_index", "", f"WITH {INDEX} SELECT * FROM ix")
def _(t):
    return index(t)


#: Cases that only folding meets; the engine that is compared with has simple lower case.
FOLDED = {" Straße ΑΣ": " strasse ας", " STRASSE ας": " strasse ας", " ﬁN": " fin"}
SPACE = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
TAILS = {k: (a, b.replace("ς", "σ")) for k, (a, b) in enumerate(FOLDED.items())}


@query("normalize_value", "", f"SELECT doc_id, concat(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '{SPACE}', ' ', 'g')), CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN '{b}'" for k, (_, b) in TAILS.items()) + " END) AS norm FROM documents WHERE trim(regexp_replace(text, '" + SPACE + "', ' ', 'g')) <> ''")
def _(t):
    tail = F.element_at(F.array(*(F.lit(f"{a} \u3000") for a, _ in TAILS.values())), (F.col("doc_id") % 3 + 1).cast("int"))
    return t("documents").where(S.squeezed(F.col("text")) != "").select("doc_id", S.normalize_value(F.concat(F.lit(" \u2003"), "text", tail)).alias("norm"))


def _found(on: str, most: int) -> str:
    return f"{INDEX}, {TERMS}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY table_id, row_no, \"column\") AS n FROM ix JOIN tm ON {on}) x WHERE n <= {most})"


EXACT, CONTAINS = "value_norm = lower(term)", "contains(value_norm, lower(term))"


@query("search_exact", "", f"WITH {_found(EXACT, 40)} SELECT term_id, value, row_no, \"column\" FROM h")
def _(t):
    return S.search_value(index(t), terms(t), True, 40).select("term_id", "value", "row_no", "column")


@query("search_contains", "", f"WITH {_found(CONTAINS, 40)} SELECT term_id, value, row_no, \"column\" FROM h")
def _(t):
    return S.search_value(stored(t), terms(t), False, 40).select("term_id", "value", "row_no", "column")


#: One table a column, so that locations differ in freshness.
LOCATED = "l AS (SELECT term_id, \"column\" AS table_id, \"column\", " + FRESH + " AS fresh, count(*) AS hits, list_sort(list(DISTINCT row_no))[1:3] AS r FROM h GROUP BY term_id, \"column\")"


def _located(t):
    hits = S.search_value(index(t), terms(t), False, 1_000_000).withColumn("table_id", F.col("column"))
    tables = t("region").select(F.explode(F.array(F.struct(F.lit("거래처명").alias("table_id"), F.lit("ok").alias("fresh")), F.struct(F.lit("팀명").alias("table_id"), F.lit("stale").alias("fresh")))).alias("x")).select("x.*").distinct()
    return S.search_locations(hits, tables)


@query("search_locations", "", f"WITH {_found(CONTAINS, 1000000)}, {LOCATED} SELECT term_id, table_id, \"column\", fresh, hits, array_to_string(r, ',') AS rows, row_number() OVER (PARTITION BY term_id ORDER BY fresh = 'ok' DESC, hits DESC, table_id) AS place FROM l")
def _(t):
    return _located(t).withColumn("rows", F.array_join("rows", ","))


@query("similar_names", "", f"WITH {_found(CONTAINS, 1000000)} SELECT 'no such customer#' AS missed, array_to_string(list_sort(list(DISTINCT value))[1:8], ';') AS similar FROM h WHERE term_id = 4")
def _(t):
    # Five terms, asked once: one pass over the values costs less than writing an index of them.
    return S.similar_names(terms(t), S.search_value(index(t), terms(t), False, 1_000_000))


@query("search_relevance", "", f"WITH {_found(CONTAINS, 1000000)}, {LOCATED} SELECT term_id, \"column\", CASE WHEN fresh = 'ok' AND term_id % 2 = 0 THEN '높음' ELSE '보통' END AS relevance, concat(CASE \"column\" WHEN '팀명' THEN 'AG' ELSE 'B' END, CAST(r[1] AS VARCHAR)) AS cell, concat(array_to_string(list_transform(r, lambda x: concat(CAST(x AS VARCHAR), '행')), ', '), CASE WHEN hits > len(r) THEN concat(' 외 ', CAST(hits - len(r) AS VARCHAR), '곳') ELSE '' END) AS places FROM l")
def _(t):
    found = _located(t)
    number = F.when(F.col("column") == "팀명", 33).otherwise(2)
    return found.select("term_id", "column", S.search_relevance(F.col("fresh"), F.col("term_id") % 2 == 0).alias("relevance"), S.hit_cell(number, F.col("rows")).alias("cell"), S.hit_rows(F.col("rows"), F.col("hits")).alias("places"))


@query("row_snippet", "", "SELECT p_partkey, substr(concat('p_name ', p_name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(', p_type ', p_type) END, ', p_size ', CAST(p_size AS VARCHAR(9))), 1, 160) AS snippet FROM part")
def _(t):
    return t("part").withColumn("p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type"))).select("p_partkey", S.row_snippet(["p_name", "p_type", "p_size"]).alias("snippet"))


@query("value_columns", "", f"WITH {_found(EXACT, 1000000)} SELECT term_id, array_to_string(list_sort(list(DISTINCT \"column\")), ',') AS columns FROM h GROUP BY term_id")
def _(t):
    return S.value_columns(index(t), terms(t))


@query("entity_dictionary", "", f"WITH {INDEX} SELECT value, kind, concat('{{', kind, '_', CAST(row_number() OVER (PARTITION BY kind ORDER BY value) AS VARCHAR(9)), '}}') AS placeholder FROM (SELECT DISTINCT value, CASE \"column\" WHEN '팀명' THEN '팀' ELSE '거래처' END AS kind FROM ix) x".replace("{{", "{").replace("}}", "}"))
def _(t):
    return S.entity_dictionary(index(t))


WORDS_OF_GLOSSARY = ", ".join(f"('{w}')" for w in dict.fromkeys(w for term, columns, words in T.GLOSSARY for w in (term, *columns, *words)) if len(w) >= 2)
DEPARTMENTS = ", ".join(f"('{d}')" for d in S.DEPARTMENTS)


@query("vocabulary", "fx_files", f"SELECT DISTINCT lower(word) AS word, origin FROM (SELECT * FROM (VALUES {WORDS_OF_GLOSSARY}) g(word), (SELECT 'glossary' AS origin) o UNION ALL SELECT c_mktsegment, 'glossary' FROM customer UNION ALL SELECT * FROM (VALUES {DEPARTMENTS}) d(word), (SELECT 'data' AS origin) o UNION ALL SELECT replace(p_type, 'E', 'É'), 'data' FROM part UNION ALL SELECT p_brand, 'data' FROM part UNION ALL SELECT word, 'data' FROM (SELECT unnest(regexp_split_to_array(path, '[/\\\\._\\-\\s()]+')) AS word FROM fx_files) p WHERE NOT regexp_matches(word, '^\\d+$') AND lower(word) NOT IN ('xlsx', 'xlsm', 'copy', 'final', '최종', '사본', '백업', 'new', 'old')) x WHERE length(word) >= 2")
def _(t):
    apart = F.replace("p_type", F.lit("E"), F.lit("E\u0301"))  # an accent of its own
    return S.vocabulary([(t("part"), apart), (t("part"), F.col("p_brand"))], [(t("fx_files"), F.col("path"))], [(t("customer"), F.col("c_mktsegment"))])


@query("search_coverage", "fx_files", f"WITH {_found(EXACT, 1000000)}, c AS (SELECT count(*) AS tried, count(*) FILTER (WHERE term_id IN (SELECT term_id FROM h)) AS found FROM tm) SELECT CASE WHEN doc_id % 10 = 0 THEN 'legacy' ELSE 'read' END AS reason, count(*) AS files, max(tried) AS tried, max(found) AS found FROM fx_files, c GROUP BY 1")
def _(t):
    files = t("fx_files").select(F.when(F.col("doc_id") % 10 == 0, "legacy").alias("skip_reason"))
    return S.search_coverage(terms(t), S.search_value(index(t), terms(t), True, 1_000_000), files)


WORDS = ("실적", "공급가액", "업체명", "재고수량", "모름", "팀", "금액 ", "채권")
ASKED = "q AS (SELECT conv_id * 100 + turn AS term_id, CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END AS term FROM conversations)"


def _asked(t):
    return t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("term_id"), F.element_at(F.array(*map(F.lit, WORDS)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")).alias("term"))


HIT = {w.strip(): next(((g, t) for t, cs, ss in T.GLOSSARY for g, ws in (("정확", (t, *cs)),) if w.strip() in ws), next((("동의어", t) for t, _, ss in T.GLOSSARY if w.strip() in ss), ("미등록", None))) for w in WORDS}


@query("match_terms", "", f"WITH {ASKED} SELECT term_id, term, CASE trim(term) " + " ".join(f"WHEN '{w}' THEN '{g}'" for w, (g, _) in HIT.items()) + " END AS grade, CASE trim(term) " + " ".join(f"WHEN '{w}' THEN '{s}'" for w, (_, s) in HIT.items() if s) + " END AS standard FROM q")
def _(t):
    return T.match_terms(_asked(t))


NAMED = ("매출실적", "재고수량표", "팀", "기말재고", "금액", "업체명", "입고수량", "비고")
#: A listing of columns: each brand's table has those that its parts' sizes stand for.
LISTED = "v AS (SELECT DISTINCT p_brand AS table_id, CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(NAMED)) + " END AS name FROM part)"


def _listed(t):
    return t("part").select(F.col("p_brand").alias("table_id"), F.element_at(F.array(*map(F.lit, NAMED)), (F.col("p_size") % 8 + 1).cast("int")).alias("name")).distinct()


@query("guess_columns", "", f"WITH {ASKED}, {LISTED} SELECT term_id, array_to_string(list_sort(list(DISTINCT name))[1:6], ',') AS guesses FROM q JOIN v ON contains(name, term) OR contains(term, name) GROUP BY term_id")
def _(t):
    return T.guess_columns(_asked(t), _listed(t))


@query("term_fallback", "", "SELECT c_custkey AS term_id, term, CASE WHEN c_custkey % 3 = 0 THEN 'value' WHEN c_custkey % 3 = 1 THEN 'file' ELSE 'unknown' END AS found_as FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'memo' ELSE 'zzz' END AS term FROM customer) x")
def _(t):
    k = F.col("c_custkey") % 3
    asked = t("customer").select(F.col("c_custkey").alias("term_id"), F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "memo").otherwise("zzz").alias("term"))
    return T.term_fallback(asked, index(t), t("fx_files").select("name").unionByName(t("region").select(F.lit("memo1").alias("name"))))


PERIODS = ("3분기 매출", "2023년 상반기", "9월 실적", "2022년 전체", "합계", "하반기 12월", "2021년 4분기")
RANGES = {0: ("3분기", None, 7, 9), 1: ("상반기", 2023, 1, 6), 2: ("9월", None, 9, 9), 3: ("연간", 2022, 1, 12), 5: ("하반기", None, 7, 12), 6: ("4분기", 2021, 10, 12)}


@query("parse_period", "", "SELECT id, text, year, make_date(year, lo, 1) AS start, last_day(make_date(year, hi, 1)) AS end, array_to_string(list_transform(range(lo, hi + 1), lambda m: concat(CAST(m AS VARCHAR), '월')), ',') AS months, defaulted AS year_defaulted FROM (SELECT conv_id * 100 + turn AS id, l AS text, CAST(coalesce(y, 2024) AS BIGINT) AS year, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, y IS NULL AS defaulted FROM conversations JOIN (VALUES " + ", ".join(f"({k}, '{l}', {y or 'NULL'}, {a}, {b})" for k, (l, y, a, b) in RANGES.items()) + ") AS v(k, l, y, lo, hi) ON (conv_id + turn) % 7 = k) x", dates="start end")
def _(t):
    asked = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.element_at(F.array(*map(F.lit, PERIODS)), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int")).alias("q"))
    return asked.select("id", T.parse_period(F.col("q"), F.lit(2024)).alias("p")).where("p is not null").select("id", "p.*").withColumn("months", F.array_join("months", ","))


NAME_RUNS = "nr AS (SELECT DISTINCT name, substr(name, i, n) AS run FROM (SELECT DISTINCT name FROM fx_files) f, range(1, 40) a(i), range(3, 40) b(n) WHERE i + n - 1 <= length(name))"


@query("pre_lookup", "fx_files", f"""WITH q AS (SELECT conv_id * 100 + turn AS id, turn % 3 AS k, concat(text, CASE turn % 3 WHEN 0 THEN ' 팀명 기말재고 2023년 3분기 9월 하반기 memo3에서 ' WHEN 1 THEN ' 매출실적 ' ELSE '' END) AS text FROM conversations), {NAME_RUNS},
tk AS (SELECT id, pos, toks[pos] AS tok FROM (SELECT id, regexp_extract_all(text, '[가-힣A-Za-z0-9_]{{3,}}') AS toks FROM q) x, unnest(range(1, len(toks) + 1)) p(pos)),
pf AS (SELECT id, pos, n, substr(tok, 1, n) AS run FROM tk, range(3, 40) b(n) WHERE n <= length(tok)),
lg AS (SELECT id, pos, max(n) AS n FROM pf WHERE run IN (SELECT run FROM nr) GROUP BY id, pos),
nm AS (SELECT pf.id, pf.pos, nr.name, row_number() OVER (PARTITION BY pf.id, pf.pos ORDER BY nr.name) AS k FROM lg JOIN pf ON lg.id = pf.id AND lg.pos = pf.pos AND lg.n = pf.n JOIN nr ON nr.run = pf.run),
ff AS (SELECT id, name, min(pos * 10 + k) AS o FROM nm WHERE k <= 3 GROUP BY id, name),
fl AS (SELECT id, array_to_string(list(name ORDER BY o)[1:5], ',') AS files FROM ff GROUP BY id)
SELECT q.id, CASE k WHEN 0 THEN '기말재고,팀명' WHEN 1 THEN '매출실적' ELSE '' END AS words, CASE k WHEN 0 THEN '2023년 3분기,9월' ELSE '' END AS periods, coalesce(files, '') AS files FROM q LEFT JOIN fl ON q.id = fl.id WHERE k < 2 OR files IS NOT NULL""")
def _(t):
    extra = F.when(F.col("turn") % 3 == 0, " 팀명 기말재고 2023년 3분기 9월 하반기 memo3에서 ").when(F.col("turn") % 3 == 1, " 매출실적 ").otherwise("")
    return T.pre_lookup(t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat("text", extra).alias("text")), t("fx_files").select("name"))


@query("standard_terms", "", f"WITH {LISTED} SELECT table_id, v.name, standard FROM v JOIN (VALUES ('매출실적', '매출실적'), ('기말재고', '재고'), ('금액', '매출실적'), ('업체명', '거래처'), ('입고수량', '수량'), ('입고수량', '입고')) AS s(name, standard) ON v.name = s.name")
def _(t):
    return T.standard_terms(_listed(t))


QUESTIONS = ("???", "furniture 합", "오늘 날씨 어때", "그럼", "매출 알려줘", "xyz qqq", "농담 해줘")


@query("scope_gate", "", "SELECT conv_id * 100 + turn AS id, CASE (conv_id + turn) % 7 WHEN 0 THEN 'nonsense' WHEN 1 THEN 'pass' WHEN 2 THEN 'offtopic' WHEN 3 THEN 'pass' WHEN 4 THEN 'pass' WHEN 5 THEN CASE WHEN turn > 0 THEN 'pass' ELSE 'offtopic' END ELSE 'offtopic' END AS verdict FROM conversations")
def _(t):
    q = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.element_at(F.array(*map(F.lit, QUESTIONS)), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int")).alias("text"), (F.col("turn") > 0).alias("in_session"))
    return T.scope_gate(q, t("customer").select(F.lower("c_mktsegment").alias("word")).unionByName(t("region").select(F.lit("furniture").alias("word"))))


@query("scope_suggestions", "", "SELECT p_type AS name, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, name LIMIT 12")
def _(t):
    return T.scope_suggestions(t("part").select(F.col("p_type").alias("name")))
