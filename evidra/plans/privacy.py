"""Queries on what may leave."""

from pyspark.sql import functions as F

from evidra.operators import privacy as P
from evidra.plans.base import query

ANY = "|".join(p for _, p in P.PATTERNS)
NAME = " ".join(f"WHEN regexp_full_match(value, '{p}') THEN '{k}'" for k, p in P.PATTERNS)
#: Every identifier with its place, and the texts between them.
KINDS = f"tk AS (SELECT id, regexp_extract_all(text, '{ANY}') AS toks, string_split_regex(text, '{ANY}') AS gaps FROM fx_texts), hits AS (SELECT id, k, toks[k] AS value FROM tk, unnest(range(1, len(toks) + 1)) p(k)), pt AS (SELECT DISTINCT CASE {NAME} END AS kind, value FROM hits), nm AS (SELECT kind, value, concat('{{', kind, '_', CAST(row_number() OVER (PARTITION BY kind ORDER BY value) AS VARCHAR(9)), '}}') AS mark FROM pt)"


@query("pattern_dictionary", "fx_texts", f"WITH {KINDS} SELECT value, mark FROM nm")
def _(t):
    return P.pattern_dictionary(t("fx_texts"))


@query("mask_entities", "", "SELECT o_orderkey AS id, concat('order of ({', CAST(o_custkey AS VARCHAR(20)), '}는 ', o_orderstatus, ' {', CAST(o_custkey AS VARCHAR(20)), '}') AS masked, 2 AS n_masked FROM orders")
def _(t):
    name = F.col("c_name")
    texts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order of ("), name, F.lit("는 "), "o_orderstatus", F.lit(" "), name).alias("text"))
    dictionary = t("customer").select(F.col("c_name").alias("value"), F.concat(F.lit("{"), F.col("c_custkey").cast("string"), F.lit("}")).alias("placeholder"))
    return P.mask_entities(texts, dictionary)


@query("mask_patterns", "fx_texts", f"WITH {KINDS}, ms AS (SELECT id, list(mark ORDER BY k) AS marks FROM hits JOIN nm USING (value) GROUP BY id) SELECT tk.id, CASE WHEN len(toks) = 0 THEN gaps[1] ELSE list_reduce(list_transform(range(1, len(gaps) + 1), lambda i: concat(gaps[i], coalesce(marks[i], ''))), lambda x, y: concat(x, y)) END AS masked FROM tk LEFT JOIN ms ON tk.id = ms.id")
def _(t):
    return P.mask_patterns(t("fx_texts")).select("id", "masked")


#: Marks without braces in two of three texts, and unknown ones that only begin like known ones.
@query("unmask_roundtrip", "fx_texts", "SELECT id, concat(text, CASE WHEN id % 3 = 0 THEN '' ELSE ' 전화_1000000 코드이메일_1월' END) AS back FROM fx_texts")
def _(t):
    texts = t("fx_texts")
    parsed = P.parse_texts(texts)
    marks = P.pattern_dictionary(texts, parsed)
    bare = F.regexp_replace("masked", r"\{((?:사업자번호|전화|이메일)_\d+)\}(?![0-9}])", "$1")
    sent = P.mask_patterns(texts, marks, parsed).select("id", F.when(F.col("id") % 3 == 0, F.col("masked")).otherwise(F.concat(bare, F.lit(" 전화_1000000 코드이메일_1월"))).alias("masked"))
    return P.unmask_texts(sent, marks)


@query("redact_injection", "fx_texts", "SELECT id, regexp_replace(regexp_replace(text, 'ignore all previous instructions', '[차단됨]'), 'system prompt', '[차단됨]') AS redacted, CASE WHEN id % 6 IN (3, 4) THEN 1 ELSE 0 END AS blocked FROM fx_texts")
def _(t):
    redacted, blocked = P.redact_injection(F.col("text"))
    return t("fx_texts").select("id", redacted.alias("redacted"), blocked.alias("blocked"))


#: Payloads with a key at some depth (written plainly or with escapes), lists of many lengths, nested ones, long texts, and broken ones.
ONE = "CASE WHEN event_id % 2 = 0 THEN CAST(i AS VARCHAR(9)) ELSE '{\"a\":[1,[2]],\"b\":\"],[\"}' END"
KEY = "CASE event_id % 13 WHEN 0 THEN '\"raw_rows\":0,' WHEN 1 THEN '\"x\":[{\"y\":{\"\\u0072aw\":[]}}],' WHEN 2 THEN '\"raw2\":\"raw\",' ELSE '' END"
PAYLOAD = f"concat('{{', {KEY}, '\"v\":[', array_to_string(list_transform(range(1, greatest(event_id % 90, 1) + 1), lambda i: {ONE}), ','), '],\"t\":\"', CASE WHEN event_id % 500 = 1 THEN repeat('x', 120001) ELSE '' END, CASE WHEN event_id % 17 = 3 THEN '' ELSE '\"}}' END)"


@query("egress_guard", "", f"WITH p AS (SELECT event_id, {PAYLOAD} AS payload FROM events), k AS (SELECT event_id, bool_or(t.key IN ('raw_rows', 'raw', 'cells', 'records')) AS bad, max(CASE WHEN t.type = 'ARRAY' THEN json_array_length(t.value) END) AS size FROM (SELECT * FROM p WHERE json_valid(payload)) p, json_tree(payload) t GROUP BY event_id) SELECT p.event_id, CASE WHEN NOT json_valid(payload) THEN 'malformed' WHEN bad THEN 'forbidden_field' WHEN size > 60 THEN 'list_too_long' WHEN length(payload) > 120000 THEN 'too_large' ELSE 'ok' END AS verdict FROM p LEFT JOIN k ON k.event_id = p.event_id")
def _(t):
    k = F.col("event_id")
    one = lambda i: F.when(k % 2 == 0, i.cast("string")).otherwise(F.concat(F.lit('{"a":[1,[2]],"b":"],["}')))
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(k % 90, F.lit(1))), one), ",")
    key = F.when(k % 13 == 0, '"raw_rows":0,').when(k % 13 == 1, '"x":[{"y":{"\\u0072aw":[]}}],').when(k % 13 == 2, '"raw2":"raw",').otherwise("")
    pad, end = F.when(k % 500 == 1, F.repeat(F.lit("x"), 120_001)).otherwise(""), F.when(k % 17 == 3, "").otherwise('"}')
    payload = F.concat(F.lit("{"), key, F.lit('"v":['), items, F.lit('],"t":"'), pad, end)
    return P.egress_guard(t("events").select(k.alias("id"), payload.alias("payload"))).withColumnRenamed("id", "event_id")


@query("audit_recent", "", "SELECT event_id AS id, ts AS at, substr(props, 1, 20000) AS sent FROM events ORDER BY ts DESC, event_id DESC LIMIT 500", dates="at")
def _(t):
    return P.audit_recent(P.audit_log(t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("props").alias("sent"))))
