"""Queries on snapshots and history."""

from pyspark.sql import functions as F

from evidra.operators import sync as Y
from evidra.plans.base import query

DIFF = """j AS (SELECT coalesce(p.path, n.path) AS path, p.sha256 AS old, n.sha256 AS now, coalesce(n.sha256, p.sha256) AS sha FROM fx_prev p FULL JOIN fx_new n ON p.path = n.path),
g AS (SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM j WHERE now IS NULL), a AS (SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM j WHERE old IS NULL),
m AS (SELECT g.path, a.path AS moved_to FROM g JOIN a ON g.sha = a.sha AND g.n = a.n)"""


@query("diff_snapshots", "fx_prev fx_new", f"WITH {DIFF} SELECT 'moved' AS change, path, moved_to FROM m UNION ALL SELECT CASE WHEN old IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'modified' END, path, NULL FROM j WHERE (old IS NULL OR now IS NULL OR old <> now) AND path NOT IN (SELECT path FROM m) AND path NOT IN (SELECT moved_to FROM m)")
def _(t):
    return Y.diff_snapshots(t("fx_prev"), t("fx_new"))


@query("scan_versions", "fx_scans", "WITH s AS (SELECT scan_id, row_number() OVER (ORDER BY scan_id) AS k FROM (SELECT DISTINCT scan_id FROM fx_scans) d), r AS (SELECT f.*, s.k FROM fx_scans f JOIN s USING (scan_id)), c AS (SELECT s.scan_id, s.k, (SELECT count(*) FROM r x WHERE x.k = s.k AND NOT EXISTS (SELECT 1 FROM r y WHERE y.k = s.k - 1 AND y.path = x.path)) AS added, (SELECT count(*) FROM r x JOIN r y ON y.k = x.k - 1 AND y.path = x.path WHERE x.k = s.k AND x.sha256 <> y.sha256) AS modified, (SELECT count(*) FROM r y WHERE y.k = s.k - 1 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.k = s.k AND x.path = y.path)) AS deleted FROM s) SELECT scan_id, added, modified, deleted, greatest(1, CAST(sum(CASE WHEN added + modified + deleted > 0 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS BIGINT)) AS version FROM c")
def _(t):
    return Y.scan_versions(t("fx_scans"))


@query("changed_listing", "fx_prev fx_new", "SELECT count(*) FILTER (WHERE p.path IS NULL OR n.path IS NULL OR p.size <> n.size OR p.mtime <> n.mtime) AS different, count(*) FILTER (WHERE p.path IS NULL OR n.path IS NULL OR p.size <> n.size OR p.mtime <> n.mtime) > 0 AS changed FROM fx_prev p FULL JOIN fx_new n ON p.path = n.path")
def _(t):
    return Y.changed_listing(t("fx_prev"), t("fx_new"))


@query("source_stamps", "fx_files", "SELECT path, substr(sha256, 1, 12) AS stamp FROM fx_files WHERE doc_id % 5 = 0")
def _(t):
    return Y.source_stamps(t("fx_files"), t("fx_files").where("doc_id % 5 = 0").select("path"))


@query("check_stamps", "fx_prev fx_new", "SELECT p.path, CASE WHEN n.sha256 IS NOT NULL AND substr(n.sha256, 1, 12) = substr(p.sha256, 1, 12) THEN 'ok' WHEN n.path IS NOT NULL THEN 'changed' WHEN substr(p.sha256, 1, 12) IN (SELECT substr(sha256, 1, 12) FROM fx_new) THEN 'moved' ELSE 'deleted' END AS state FROM fx_prev p LEFT JOIN fx_new n ON p.path = n.path")
def _(t):
    return Y.check_stamps(t("fx_prev").select("path", F.left("sha256", F.lit(12)).alias("stamp")), t("fx_new"))


KIND = "concat(p_type, ' ', CAST(p_size AS VARCHAR(9)))"
NAMES = f"CASE WHEN p_partkey % 5 = 0 THEN concat('_', p_type) WHEN p_partkey % 7 = 0 THEN '12월' WHEN p_partkey % 11 = 0 THEN '2024' ELSE {KIND} END"
#: Columns of each company's files; of the first two companies some are known, the others are scanned for the first time.
NAMED = f"nd AS (SELECT p_partkey % 3 AS company, {NAMES} AS name, p_brand AS path, p_size % 10 AS day FROM part), kn AS (SELECT DISTINCT p_partkey % 3 AS company, {KIND} AS name FROM part WHERE p_size % 4 = 1 AND p_partkey % 3 < 2)"
NEW = f"{NAMED}, nw AS (SELECT DISTINCT company, name FROM nd WHERE company < 2 AND length(name) BETWEEN 2 AND 30 AND NOT starts_with(name, '_') AND name NOT IN ('12월', '2024') AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.company = nd.company AND kn.name = nd.name))"


def kind_of():
    return F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))


def _named(t):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("_"), "p_type")).when(k % 7 == 0, "12월").when(k % 11 == 0, "2024").otherwise(kind_of())
    return t("part").select((k % 3).alias("company"), name.alias("name"), F.col("p_brand").alias("path"), (F.col("p_size") % 10).alias("day"))


def _known(t):
    return t("part").where("p_size % 4 = 1 and p_partkey % 3 < 2").select((F.col("p_partkey") % 3).alias("company"), kind_of().alias("name")).distinct()


@query("new_columns", "", f"WITH {NEW} SELECT company, name FROM nw")
def _(t):
    return Y.new_columns(_named(t), _known(t))


@query("glossary_candidates", "", f"WITH {NEW}, c AS (SELECT nw.company, nw.name, max(day) AS seen, array_to_string(list_sort(list(DISTINCT path))[1:5], ';') AS files FROM nw JOIN nd ON nd.company = nw.company AND nd.name = nw.name GROUP BY ALL) SELECT company, name, files, row_number() OVER (PARTITION BY company ORDER BY seen DESC, name) AS place FROM c WHERE NOT (name LIKE '%A%' AND company = 1) AND name NOT LIKE 'S%'")
def _(t):
    seen = _named(t).groupBy("company", "name").agg(F.max("day").alias("first_seen"))
    fresh = Y.new_columns(_named(t), _known(t)).join(seen, ["company", "name"])
    names = _named(t).select("company", "name").distinct()
    return Y.glossary_candidates(fresh, names.where("name like '%A%' and company = 1"), names.where("name like 'S%'").withColumn("name", F.lower("name")), _named(t))


@query("upsert_latest", "", "SELECT user_id, arg_max(value, [epoch_us(ts), event_id]) AS value, min(ts) AS created_at FROM (SELECT user_id, ts, event_id, value FROM events) e GROUP BY user_id", dates="created_at")
def _(t):
    rows = t("events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return Y.upsert_latest(rows, "user_id", "at", ["value"]).select("user_id", "value", F.col("created_at.ts").alias("created_at"))


@query("delete_by_id", "", "SELECT event_id, user_id FROM events WHERE event_type <> (SELECT min(event_type) FROM events)")
def _(t):
    low = t("events").agg(F.min("event_type").alias("event_type"))
    gone = t("events").join(F.broadcast(low), "event_type").select("event_id")
    return Y.delete_by_id(t("events"), gone, "event_id").select("event_id", "user_id")


@query("recent_history", "", "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n <= 50")
def _(t):
    return Y.recent(t("events"), "event_type", "ts", "event_id", 50).select("event_type", "event_id", "user_id")
