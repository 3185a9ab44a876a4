"""Queries on cell grids."""

from pyspark.sql import functions as F

from evidra.operators import ingest as I
from evidra.plans.base import query

KEPT = "k AS (SELECT * FROM (SELECT sheet, row_no, col_no, kind, CASE WHEN kind = 's' THEN nullif(trim(v_text), '') ELSE v_text END AS v_text, v_num FROM fx_cells) x WHERE kind <> 'e' AND (kind <> 's' OR v_text IS NOT NULL))"
KIND = "CASE WHEN t = 'Total' THEN 'total' ELSE 'data' END"
ROWS = f"{KEPT}, b AS (SELECT * FROM k WHERE row_no > 5), r AS (SELECT sheet, row_no, max(CASE WHEN v_text = 'Total' AND col_no = 1 THEN 'total' ELSE 'data' END) AS row_kind FROM b GROUP BY sheet, row_no)"


def tables(t):
    """Cells, headers, body, row kinds and types of the fixture's sheets."""
    cells = t("fx_cells")
    headers = I.detect_header(cells)
    body = I.body(cells, headers)
    kinds = I.row_kinds(body)
    return cells, headers, body, kinds, I.infer_types(body, kinds)


@query("fingerprint", "fx_files", "SELECT path, sha256, substr(sha256, 1, 12) AS stamp FROM fx_files")
def _(t):
    joined = t("fx_files").join(t("documents").select("doc_id", "text"), "doc_id")
    sha = F.sha2("text", 256)
    return joined.select("path", sha.alias("sha256"), F.left(sha, F.lit(12)).alias("stamp"))


@query("lock_match", "fx_files", "SELECT path, concat('user', CAST(doc_id AS VARCHAR(20))) AS owner FROM fx_files WHERE doc_id % 9 = 0")
def _(t):
    from evidra.sources.listing import mark_locked

    files = t("fx_files")
    hidden = F.when(F.col("doc_id") % 2 == 0, F.col("name")).otherwise(F.expr("substr(name, 2)"))
    locks = files.where("doc_id % 9 = 0").select("folder", F.concat(F.lit("~$"), hidden).alias("name"), F.concat(F.lit("user"), F.col("doc_id").cast("string")).alias("owner"), F.lit(None).cast("string").alias("since"))
    return mark_locked(files.select("path", "folder", "name"), locks).where("owner is not null").select("path", "owner")


@query("cells_unpivot", "", "SELECT sheet, row_no, col_no, kind, v_text, v_num FROM (SELECT 'customer' AS sheet, c_custkey AS row_no, CAST(1 AS BIGINT) AS col_no, 's' AS kind, c_name AS v_text, CAST(NULL AS DOUBLE) AS v_num FROM customer UNION ALL SELECT 'customer', c_custkey, 2, 'n', NULL, c_acctbal FROM customer UNION ALL SELECT 'customer', c_custkey, 3, 's', c_mktsegment, NULL FROM customer) x")
def _(t):
    keyed = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    plain = I.cells_from_table(keyed, F.lit("customer"), F.col("c_custkey"))
    return plain.where("col_no > 1").withColumn("col_no", F.col("col_no") - 1)


@query("clean_cells", "fx_cells", f"WITH {KEPT} SELECT sheet, kind, count(*) AS n, min(v_text) AS low FROM k GROUP BY sheet, kind")
def _(t):
    return I.clean_cells(t("fx_cells")).where("kind <> 'e'").groupBy("sheet", "kind").agg(F.count("*").alias("n"), F.min("v_text").alias("low"))


@query("error_cells", "fx_cells", "SELECT sheet, count(*) FILTER (WHERE kind = 'e') AS error_cells FROM fx_cells GROUP BY sheet")
def _(t):
    return I.error_cells(t("fx_cells"))


@query("row_cap", "fx_cells", "SELECT sheet, count(DISTINCT row_no) AS n_rows, least(count(DISTINCT row_no), 8) AS kept, count(DISTINCT row_no) > 8 AS truncated FROM fx_cells WHERE kind <> 'e' GROUP BY sheet")
def _(t):
    return I.row_cap(t("fx_cells"), 8)


@query("detect_header", "fx_cells", "SELECT DISTINCT sheet, CAST(5 AS BIGINT) AS header_row FROM fx_cells")
def _(t):
    return I.detect_header(t("fx_cells"))


@query("header_like", "fx_cells", f"WITH {KEPT} SELECT sheet, row_no, bool_and(kind = 's') AS header_like FROM k WHERE row_no <= 30 GROUP BY sheet, row_no")
def _(t):
    return I._as_rows(t("fx_cells").where("row_no <= 30"), 100).select("sheet", "row_no", I.header_like(F.col("cells")).alias("header_like"))


@query("note_like", "fx_cells", f"WITH {KEPT} SELECT sheet, row_no, bool_or(coalesce(regexp_matches(v_text, '(단위|기준일)\\s*[:：]?\\s*$|[:：]'), false)) AS note_like FROM k WHERE row_no <= 30 GROUP BY sheet, row_no")
def _(t):
    return I._as_rows(t("fx_cells").where("row_no <= 30"), 100).select("sheet", "row_no", I.note_like(F.col("cells")).alias("note_like"))


@query("preamble", "fx_cells", "SELECT DISTINCT sheet, concat('Price list ', sheet, chr(10), '기준일: 2024-03-01', chr(10), '(단위: 천원)') AS preamble FROM fx_cells")
def _(t):
    return I.preamble(t("fx_cells"), I.detect_header(t("fx_cells")))


@query("kept_columns", "fx_cells", f"WITH {KEPT} SELECT sheet, col_no, max(CASE WHEN row_no = 5 THEN v_text END) AS header FROM k WHERE row_no >= 5 GROUP BY sheet, col_no")
def _(t):
    return I.kept_columns(t("fx_cells"), I.detect_header(t("fx_cells")))


@query("column_names", "fx_cells", "SELECT DISTINCT sheet, col_no, CASE col_no WHEN 1 THEN 'key' WHEN 2 THEN 'name' WHEN 3 THEN 'size' ELSE 'price' END AS name FROM fx_cells WHERE row_no >= 5")
def _(t):
    return I.column_names(I.kept_columns(t("fx_cells"), I.detect_header(t("fx_cells"))))


@query("row_kind", "fx_cells", f"WITH {ROWS} SELECT sheet, row_no, row_kind, CASE WHEN row_kind = 'total' THEN 'Total' END AS label FROM r")
def _(t):
    return tables(t)[3]


TYPED = f"{ROWS}, y AS (SELECT sheet, col_no, count(*) FILTER (WHERE row_kind = 'data') AS n, bool_and(kind = 'n') FILTER (WHERE row_kind = 'data') AS num, bool_or(kind = 'n') FILTER (WHERE row_kind = 'data') AS some_num, bool_and(v_num = floor(v_num)) FILTER (WHERE kind = 'n') AS whole FROM b JOIN r USING (sheet, row_no) GROUP BY sheet, col_no), ty AS (SELECT sheet, col_no, CASE WHEN num AND whole THEN 'BIGINT' WHEN num THEN 'DOUBLE' ELSE 'VARCHAR' END AS dtype, some_num AND NOT num AS mixed FROM y)"


@query("infer_types", "fx_cells", f"WITH {TYPED} SELECT sheet, col_no, dtype, mixed FROM ty")
def _(t):
    return tables(t)[4]


PLAIN = "CASE WHEN kind = 'n' AND v_num = floor(v_num) THEN CAST(CAST(v_num AS BIGINT) AS VARCHAR(30)) WHEN kind = 'n' THEN CAST(v_num AS VARCHAR(30)) ELSE v_text END"


@query("coerce", "fx_cells", f"WITH {TYPED} SELECT sheet, row_no, col_no, dtype, CASE WHEN dtype = 'VARCHAR' THEN {PLAIN} END AS v_str, CASE WHEN dtype = 'BIGINT' AND kind = 'n' THEN CAST(v_num AS BIGINT) END AS v_int, CASE WHEN dtype = 'DOUBLE' AND kind = 'n' THEN v_num END AS v_dbl FROM b JOIN ty USING (sheet, col_no)")
def _(t):
    _, _, body, _, types = tables(t)
    return I.coerce(body, types).drop("v_day")


@query("cell_text", "fx_cells", f"WITH {KEPT} SELECT sheet, row_no, col_no, {PLAIN} AS text FROM k WHERE col_no < 4")
def _(t):
    cells = I.clean_cells(t("fx_cells")).where("kind <> 'e' and col_no < 4")
    return cells.select(*I.CELL, I.cell_text(F.col("kind"), F.col("v_text"), F.col("v_num")).alias("text"))


@query("materialize_layout", "fx_cells", f"WITH {ROWS} SELECT sheet, row_no, max(CASE WHEN col_no = 1 THEN {PLAIN} END) AS key, max(CASE WHEN col_no = 2 THEN v_text END) AS name, max(CASE WHEN col_no = 3 THEN {PLAIN} END) AS size FROM b JOIN r USING (sheet, row_no) WHERE row_kind = 'data' GROUP BY sheet, row_no")
def _(t):
    cells, headers, body, kinds, types = tables(t)
    names = I.column_names(I.kept_columns(cells, headers))
    data = I.coerce(body, types).join(kinds.where("row_kind = 'data'").select("sheet", "row_no"), ["sheet", "row_no"])
    return I.materialize_layout(data, names, ["key", "name", "size"])


@query("scan_summary", "fx_files", "WITH s AS (SELECT *, sum(size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fx_files) SELECT status, count(*) AS files, CAST(sum(size) AS BIGINT) AS n_rows FROM (SELECT size, CASE WHEN doc_id % 10 = 0 THEN 'skipped: legacy' WHEN coalesce(before, 0) >= 200000 THEN 'error' WHEN doc_id % 7 = 0 THEN 'partial' ELSE 'ok' END AS status FROM s) x GROUP BY status")
def _(t):
    listed = t("fx_files").select("path", F.col("size").alias("n_rows"), F.when(F.col("doc_id") % 10 == 0, "legacy").alias("skip_reason"), (F.col("doc_id") % 7 == 0).alias("truncated"))
    return I.scan_summary(listed, 200_000)
