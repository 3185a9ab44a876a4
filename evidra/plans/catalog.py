"""Queries on the catalog of files."""

import unicodedata
from functools import reduce

from pyspark.sql import functions as F

from evidra.operators import axes as X
from evidra.operators import catalog as B
from evidra.operators import reconcile as R
from evidra.plans.base import query

LABELS = ", ".join(f"'{d}'" for d in B.DEPARTMENTS)
DEPT = f"coalesce(list_filter(string_split(path, '/')[1:-2], lambda p: list_contains([{LABELS}], p))[1], list_filter([{LABELS}], lambda d: contains(string_split(path, '/')[-1], d))[1], '{B.UNCLASSIFIED}')"
TOP = "CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[1] ELSE '' END"
# Suffixes of the fixture's names; a stem keeps its number.
STEM = "regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '(\\(\\d+\\)|_old|_final|_v\\d+)+$', '')"
BASE = "least(coalesce(base_date, mtime), mtime)"
FACTS = f"""k AS (SELECT *, {DEPT} AS dept, {TOP} AS top, {STEM} AS st, CAST({BASE} AS DATE) AS data_date FROM fx_files),
o AS (SELECT *, first_value(path) OVER (PARTITION BY sha256 ORDER BY CASE WHEN top IN ({LABELS}) THEN 0 ELSE 1 END, mtime, CASE WHEN regexp_matches(name, '\\(\\d+\\)') THEN 1 ELSE 0 END, length(name), path) AS orig FROM k),
y AS (SELECT *, CASE WHEN orig <> path THEN orig END AS copy_of FROM o),
fam AS (SELECT st, dept, count(DISTINCT folder) AS n, min(folder) AS only_one FROM k WHERE top IN ({LABELS}) GROUP BY st, dept),
f AS (SELECT y.*, CASE WHEN top IN ({LABELS}) THEN concat(y.st, '|', y.dept, '|', folder) WHEN fam.n = 1 THEN concat(y.st, '|', y.dept, '|', only_one) ELSE concat(y.st, '|', y.dept, '|') END AS family FROM y LEFT JOIN fam ON y.st = fam.st AND y.dept = fam.dept),
w AS (SELECT family, max(data_date) AS newest, arg_min(path, [epoch(CAST(data_date AS TIMESTAMP)) * -1, 0]) AS any_first FROM f WHERE copy_of IS NULL GROUP BY family),
w1 AS (SELECT f.family, min(path) AS first FROM f JOIN w ON f.family = w.family AND f.data_date = w.newest WHERE copy_of IS NULL GROUP BY f.family),
g AS (SELECT f.*, newest, CASE WHEN copy_of IS NOT NULL THEN 'copy' WHEN data_date = newest THEN 'ok' ELSE 'stale' END AS fresh, first FROM f LEFT JOIN w ON f.family = w.family LEFT JOIN w1 ON f.family = w1.family)""".replace(", arg_min(path, [epoch(CAST(data_date AS TIMESTAMP)) * -1, 0]) AS any_first", "")


def files(t):
    """Files with department, stem, base date, copy, family and freshness."""
    base = t("fx_files").withColumn("dept", B.classify_department(F.col("path"))).withColumn("stem", B.family_stem(F.col("name"))).withColumn("data_date", B.data_date(F.split("preamble", "\n"), F.col("mtime")))
    return B.assign_freshness(B.assign_families(B.detect_copies(base)))


#: Names as some desktops write them, syllables taken apart, in every other path.
APART = {d: unicodedata.normalize("NFD", d) for d in B.DEPARTMENTS}
TAKEN_APART = reduce(lambda x, d: f"replace({x}, '{d}', '{APART[d]}')", APART, "path")


@query("classify_department", "fx_files", f"SELECT CASE WHEN doc_id % 2 = 0 THEN {TAKEN_APART} ELSE path END AS path, {DEPT} AS dept FROM fx_files")
def _(t):
    apart = reduce(lambda x, d: F.replace(x, F.lit(d), F.lit(APART[d])), APART, F.col("path"))
    named = t("fx_files").select(F.when(F.col("doc_id") % 2 == 0, apart).otherwise(F.col("path")).alias("path"))
    return named.select("path", B.classify_department(F.col("path")).alias("dept"))


@query("top_folder", "fx_files", f"SELECT path, {TOP} AS top FROM fx_files")
def _(t):
    return t("fx_files").select("path", B.top_folder(F.col("path")).alias("top"))


@query("family_stem", "fx_files", f"SELECT path, {STEM} AS stem FROM fx_files")
def _(t):
    return t("fx_files").select("path", B.family_stem(F.col("name")).alias("stem"))


@query("data_date", "fx_files", f"SELECT path, CAST({BASE} AS DATE) AS data_date FROM fx_files", dates="data_date")
def _(t):
    return t("fx_files").select("path", B.data_date(F.split("preamble", "\n"), F.col("mtime")).alias("data_date"))


@query("detect_copies", "fx_files", f"WITH {FACTS} SELECT path, copy_of FROM y")
def _(t):
    return B.detect_copies(t("fx_files")).select("path", "copy_of")


@query("assign_families", "fx_files", f"WITH {FACTS} SELECT path, family FROM f")
def _(t):
    return files(t).select("path", "family")


@query("assign_freshness", "fx_files", f"WITH {FACTS}, t AS (SELECT a.path, array_to_string(list_sort(list(DISTINCT b.path)), ',') AS tie_with FROM g a JOIN g b ON a.family = b.family AND a.fresh = 'ok' AND b.fresh = 'ok' AND a.sha256 <> b.sha256 GROUP BY a.path) SELECT g.path, fresh, CASE WHEN fresh = 'stale' THEN first END AS newer, tie_with FROM g LEFT JOIN t ON g.path = t.path")
def _(t):
    return files(t).select("path", "fresh", "newer", F.array_join("tie_with", ",").alias("tie_with"))


TOTALS = "SELECT l_returnflag AS path, CAST(year(l_shipdate) AS VARCHAR(9)) AS sheet, c AS col, CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE) * CASE WHEN c = '할인률' THEN 1 ELSE 1000 END AS total FROM (SELECT l_returnflag, l_shipdate, '금액' AS c, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_returnflag, l_shipdate, '할인률', l_discount FROM lineitem) x GROUP BY 1, 2, 3"


def _totals(t):
    long = t("lineitem").select(F.col("l_returnflag").alias("path"), F.year("l_shipdate").cast("string").alias("sheet"), F.col("l_extendedprice").alias("금액"), F.col("l_discount").alias("할인률")).unpivot(["path", "sheet"], ["금액", "할인률"], "column", "value")
    return B.numeric_totals(long, F.lit(1000))


@query("numeric_totals", "", TOTALS)
def _(t):
    return _totals(t).withColumnRenamed("column", "col")


@query("format_copy", "", f"WITH n AS ({TOTALS}) SELECT a.path AS a, b.path AS b, bool_and(abs(a.total - b.total) <= 0.005 * greatest(abs(a.total), abs(b.total), 1.0)) AS same_data, count(*) AS compared FROM n a JOIN n b ON a.path <= b.path AND a.sheet = b.sheet AND a.col = b.col GROUP BY a.path, b.path")
def _(t):
    flags = t("lineitem").select(F.col("l_returnflag").alias("a")).distinct()
    pairs = flags.join(flags.select(F.col("a").alias("b")), F.col("a") <= F.col("b"))
    return B.same_data(pairs, _totals(t))


TIED = "tw AS (SELECT a.path, list_sort(list(DISTINCT b.path)) AS tw FROM g a JOIN g b ON a.family = b.family AND a.fresh = 'ok' AND b.fresh = 'ok' AND a.sha256 <> b.sha256 GROUP BY a.path), tp AS (SELECT path, list_sort(list_transform(list_concat([path], tw), lambda p: {'n': length(string_split(p, '/')[-1]), 'p': p}))[1].p AS prim, (length(path) + length(tw[1])) % 2 = 0 AS alike FROM tw)"


def _primaries(t):
    """Pairs are alike here if their paths' lengths add up to an even number; ``format_copy`` tells it from totals."""
    ties = files(t).where("tie_with is not null").select("path", "tie_with")
    first = ties.select(F.col("path").alias("a"), F.col("tie_with")[0].alias("b"))
    return B.tie_primary(ties, first.withColumn("same_data", (F.length("a") + F.length("b")) % 2 == 0))


@query("tie_primary", "fx_files", f"WITH {FACTS}, {TIED} SELECT path, prim AS \"primary\", path <> prim AND alike AS format_copy FROM tp")
def _(t):
    return _primaries(t)


COLUMNS = "SELECT concat(folder, '/', st) AS table_id, name FROM (SELECT DISTINCT folder, stem AS st, doc_id % 4 AS k FROM fx_files) x, (SELECT '금액' AS name, 0 AS z UNION ALL SELECT '거래처명', 1 UNION ALL SELECT '기말재고', 2 UNION ALL SELECT '월', 3) n WHERE k <> z"


def _columns(t):
    tables = t("fx_files").select("folder", "stem", (F.col("doc_id") % 4).alias("k")).distinct()
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(z).alias("z")) for z, n in enumerate(("금액", "거래처명", "기말재고", "월"))))
    return tables.select(F.concat_ws("/", "folder", "stem").alias("table_id"), "k", F.explode(names).alias("x")).where("k <> x.z").select("table_id", "x.name")


TABLES = f"tb AS (SELECT table_id, path, {DEPT} AS dept, title FROM (SELECT concat(folder, '/', stem) AS table_id, concat(folder, '/', stem, '.xlsx') AS path, concat('Report ', CAST(2023 + min(doc_id % 4) % 2 AS VARCHAR(9))) AS title FROM fx_files GROUP BY folder, stem) y)"
ASKED = {1: ("금액,거래처|업체", None, None, None), 2: ("재고", None, None, None), 3: ("월", 2024, "회계팀", None), 4: ("월", 2023, None, "memo1")}
WANTED = {1: "bool_or(contains(name, '금액')) AND bool_or(contains(name, '거래처') OR contains(name, '업체'))", 2: "bool_or(contains(name, '재고'))", 3: "bool_or(contains(name, '월'))", 4: "bool_or(contains(name, '월'))"}


@query("catalog_search", "fx_files", f"WITH c AS ({COLUMNS}), {TABLES}, m AS (" + " UNION ALL ".join(f"SELECT {k} AS request_id, table_id FROM c GROUP BY table_id HAVING {w}" for k, w in WANTED.items()) + ") SELECT request_id, table_id FROM m JOIN tb USING (table_id) WHERE request_id < 3 OR (request_id = 3 AND dept = '회계팀' AND contains(title, '2024')) OR (request_id = 4 AND contains(path, 'memo1') AND contains(title, '2023'))")
def _(t):
    k = F.col("r_regionkey").cast("int")
    pick = lambda i, kind: F.coalesce(*(F.when(k == n, F.lit(a[i])) for n, a in ASKED.items())).cast(kind)
    requests = t("region").where(k.isin(*ASKED)).select(k.alias("request_id"), F.split(pick(0, "string"), ",").alias("wants"), pick(1, "int").alias("year"), pick(2, "string").alias("dept"), pick(3, "string").alias("file"))
    path = F.concat("folder", F.lit("/"), "stem", F.lit(".xlsx"))
    tables = t("fx_files").groupBy("folder", "stem").agg(F.min(F.col("doc_id") % 4).alias("k")).select(F.concat_ws("/", "folder", "stem").alias("table_id"), path.alias("path"), B.classify_department(path).alias("dept"), F.concat(F.lit("Report "), (2023 + F.col("k") % 2).cast("string")).alias("title"))
    return B.catalog_search(_columns(t), requests, tables)


@query("catalog_excluded", "fx_files", f"WITH {FACTS}, {TIED} SELECT request_id, path, reason FROM (SELECT dept AS request_id, g.path, CASE WHEN fresh = 'stale' THEN concat('newer: ', coalesce(first, '')) WHEN fresh = 'copy' THEN concat('copy of ', copy_of) ELSE concat('same data in another format: ', string_split(prim, '/')[-1]) END AS reason, row_number() OVER (PARTITION BY dept ORDER BY g.path) AS n FROM g LEFT JOIN tp ON g.path = tp.path WHERE fresh <> 'ok' OR (g.path <> prim AND alike)) x WHERE n <= 10")
def _(t):
    copies = _primaries(t).where("format_copy").select("path", F.col("primary").alias("format_of"))
    return B.catalog_excluded(files(t).withColumn("request_id", F.col("dept")).join(copies, "path", "left"))


@query("catalog_order", "fx_files", f"WITH {FACTS} SELECT request_id, path, place FROM (SELECT dept AS request_id, path, row_number() OVER (PARTITION BY dept ORDER BY contains(name, 'memo1'), data_date DESC, path) AS place FROM g) x WHERE place <= 12")
def _(t):
    return B.catalog_order(files(t).select(F.col("dept").alias("request_id"), "path", F.col("name").contains("memo1").alias("excerpt"), "data_date")).select("request_id", "path", "place")


WISHED = {"금액": "금액", "거래|업체": "거래|업체", "단가": "단가"}


@query("closest_tables", "fx_files", f"WITH c AS ({COLUMNS}), m AS (SELECT table_id, bool_or(contains(name, '금액')) AS x, bool_or(regexp_matches(name, '거래|업체')) AS y FROM c WHERE table_id NOT LIKE '%3%' GROUP BY table_id) SELECT table_id, concat_ws(',', CASE WHEN x THEN '금액' END, CASE WHEN y THEN '거래|업체' END) AS has, concat_ws(',', CASE WHEN NOT x THEN '금액' END, CASE WHEN NOT y THEN '거래|업체' END, '단가') AS missing FROM m WHERE x OR y ORDER BY CAST(x AS INT) + CAST(y AS INT) DESC, table_id LIMIT 5")
def _(t):
    columns = _columns(t)
    tables = columns.select("table_id", F.when(F.col("table_id").contains("3"), "stale").otherwise("ok").alias("fresh")).distinct()
    return B.closest_tables(columns, tables, list(WISHED))


@query("known_columns", "fx_files", f"WITH c AS ({COLUMNS}) SELECT name, count(DISTINCT table_id) AS tables FROM c GROUP BY name ORDER BY tables DESC, name LIMIT 50")
def _(t):
    return B.known_columns(_columns(t))


#: Axes of the fixture's tables: a range of dates, a set of months, or none (another label).
AXES = """ax AS (SELECT *, CASE WHEN s IS NOT NULL THEN 'dates' WHEN len(ms) > 0 AND len(list_filter(ms, lambda m: NOT regexp_matches(m, '^(1[0-2]|[1-9])월$'))) = 0 THEN 'months' END AS kind
FROM (SELECT table_id, path, signature, stock, base_date, min(day) AS s, max(day) AS e, list(DISTINCT month_label) FILTER (WHERE month_label IS NOT NULL) AS ms FROM fx_axis GROUP BY ALL) g)"""
OVERLAP = "coalesce((a.kind = 'dates' AND b.kind = 'dates' AND a.s <= b.e AND b.s <= a.e) OR (a.kind = 'months' AND b.kind = 'months' AND list_has_any(a.ms, b.ms)), false)"
TABLE = ["table_id", "path", "signature", "stock", "base_date"]


def axes(t):
    return X.time_axis(t("fx_axis"), TABLE, F.col("day"), F.col("month_label"))


@query("time_axis", "fx_axis", f"WITH {AXES} SELECT table_id, kind, s AS start, e AS end, CASE WHEN kind = 'months' THEN CAST(list_sum(list_transform(ms, lambda m: 1 << CAST(replace(m, '월', '') AS INTEGER))) AS INTEGER) END AS months FROM ax", dates="start end")
def _(t):
    return axes(t).select("table_id", "kind", "start", "end", "months")


@query("axes_overlap", "fx_axis", f"WITH RECURSIVE {AXES}, r AS (SELECT table_id AS a, table_id AS b FROM ax WHERE kind IS NOT NULL UNION SELECT r.a, b.table_id FROM r JOIN ax a ON a.table_id = r.b JOIN ax b ON a.signature = b.signature AND {OVERLAP}) SELECT ax.table_id, min(r.b) AS group_first, CASE WHEN count(r.b) > 0 THEN count(r.b) END AS group_size FROM ax LEFT JOIN r ON r.a = ax.table_id GROUP BY ax.table_id")
def _(t):
    found = X.overlap_groups(axes(t))
    first = found.groupBy("signature", "time_group").agg(F.min("table_id").alias("group_first"))
    return found.join(first, ["signature", "time_group"], "left").select("table_id", "group_first", "group_size")


@query("same_layout", "fx_axis", f"WITH {AXES} SELECT a, b FROM (SELECT a.table_id AS a, b.table_id AS b, row_number() OVER (PARTITION BY a.table_id ORDER BY a.path = b.path DESC, b.base_date DESC, b.table_id) AS n FROM ax a JOIN ax b ON a.signature = b.signature AND a.table_id <> b.table_id WHERE a.path = b.path OR (a.kind IS NOT NULL AND b.kind IS NOT NULL AND NOT {OVERLAP})) p WHERE n <= 40")
def _(t):
    return X.same_layout(axes(t).withColumnRenamed("base_date", "data_date"))


@query("latest_year", "fx_files", f"WITH {FACTS} SELECT CAST(year(max(data_date)) AS BIGINT) AS year FROM g WHERE fresh = 'ok'")
def _(t):
    return B.latest_year(files(t))


@query("catalog_listing", "fx_files fx_cells", "SELECT f.path, coalesce(n, 0) AS sheets, CAST(coalesce(r, 0) AS BIGINT) AS n_rows, names FROM fx_files f LEFT JOIN (SELECT path, count(*) AS n, sum(n_rows) AS r, array_to_string(list_sort(list(stem)), ',') AS names FROM (SELECT path, stem, size % 100 AS n_rows FROM fx_files WHERE doc_id % 2 = 0 UNION ALL SELECT path, 'notes', 1 FROM fx_files WHERE doc_id % 4 = 0) s GROUP BY path) c ON f.path = c.path")
def _(t):
    files_ = t("fx_files")
    sheets = files_.where("doc_id % 2 = 0").select("path", F.col("stem").alias("sheet"), (F.col("size") % 100).alias("n_rows")).unionByName(files_.where("doc_id % 4 = 0").select("path", F.lit("notes").alias("sheet"), F.lit(1).cast("long").alias("n_rows")))
    return B.catalog_listing(files_, sheets)


@query("catalog_tree", "fx_files", f"WITH {FACTS} SELECT dept, sub, count(*) AS files, count(*) FILTER (WHERE fresh <> 'ok') AS not_fresh FROM (SELECT *, string_split(path, '/')[2] AS sub FROM g) x GROUP BY ROLLUP (dept, sub)")
def _(t):
    return B.catalog_tree(files(t).withColumn("sub", F.split("path", "/")[1]))


@query("is_excerpt", "", "SELECT conv_id, turn, regexp_matches(concat(CASE WHEN turn % 3 = 0 THEN '발췌 ' ELSE '' END, role), '발췌|복사|인용|재편집') AS excerpt FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", R.is_excerpt(F.concat(F.when(F.col("turn") % 3 == 0, "발췌 ").otherwise(""), "role")).alias("excerpt"))
