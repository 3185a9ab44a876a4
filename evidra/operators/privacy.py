"""What may leave: masking of names and numbers, redaction of instruction-like text, a guard on payloads, an audit log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.joins import small
from evidra.functions.ranges import numbered
from evidra.functions.storage import stored
from evidra.operators.audits import INJECTION

# Patterns of identifiers, forbidden fields and limits of payloads.
PATTERNS = (("사업자번호", r"\b\d{3}-\d{2}-\d{5}\b"), ("전화", r"\b0\d{1,2}-\d{3,4}-\d{4}\b"), ("이메일", r"[\w.+-]+@[\w-]+\.[\w.-]+"))
#: The same matches, told without trying every letter of a word as a beginning.
FINDERS = tuple((kind, p.replace(r"[\w.+-]+@", r"(?<![\w.+-])[\w.+-]++@")) for kind, p in PATTERNS)
ANY = "|".join(p for _, p in FINDERS)
#: Marks, with braces or without.
MARK = r"\{(?:사업자번호|전화|이메일)_\d+\}|(?<![0-9A-Za-z가-힣{])(?:사업자번호|전화|이메일)_\d+(?![0-9}])"
#: Values of which one automaton is made.
MOST_ENTRIES = 100_000
#: Of more values: lengths of heads to choose from, distinct heads that every task has, and letters of a text's piece.
HEADS, MOST_HEADS, PIECE = (12, 8, 6, 4, 3, 2), 20_000, 256
FORBIDDEN = ("raw_rows", "raw", "cells", "records")
MOST_ITEMS, MOST_CHARS, SENT_CHARS, MOST_RECENT = 60, 120_000, 20_000, 500
BLOCKED = "[차단됨]"


def _joined(gaps: Column, marks: Column) -> Column:
    """Gaps of a text and what stands between them, put together in one pass."""
    return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def _automaton(entries: list[tuple[str, str]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for value, mark in entries:
        found.add_word(value, (len(value), mark))
    found.make_automaton()
    return found


def _masked_by(entries: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (id, text) to (id, masked, n_masked): at each place the longest value, from left to right."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(entries.value)
        for batch in batches:
            masked, counts = [], []
            for text in batch.column("text").to_pylist():
                parts, last, n = [], 0, 0
                for end, (size, mark) in automaton.iter_long(text) if text and entries.value else ():
                    parts += [text[last : end + 1 - size], mark]
                    last, n = end + 1, n + 1
                masked.append(text if text is None else "".join([*parts, text[last:]]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(masked, pa.string()), pa.array(counts, pa.int32())], ["id", "masked", "n_masked"])

    return run


def mask_entities(texts: DataFrame, dictionary: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """Texts (id, text) with known values (value, placeholder) masked wherever they stand, also within words; at each place the longest, from left to
    right, never within a mark. ``n_masked`` counts places; of equal values the first placeholder holds.

    Up to ``most`` values make one automaton that every task has. More are met by equi-joins (``_places``)."""
    known = dictionary.where(F.length("value") > 0).groupBy("value").agg(F.min("placeholder").alias("mark"))
    if small(known, most):
        entries = [tuple(r) for r in known.collect()]  # no more than ``most``
        kind = texts.schema["id"].dataType.simpleString()
        return texts.select("id", "text").mapInArrow(_masked_by(texts.sparkSession.sparkContext.broadcast(entries)), f"id {kind}, masked string, n_masked int")
    own = texts.select("id", "text", F.xxhash64("text").alias("_h"))
    held = _places(own, known).groupBy("id", "_h").agg(F.array_sort(F.collect_set(F.struct("at", F.negate("n").alias("n"), "mark"))).alias("e"))

    def step(s: Column, e: Column) -> Column:
        """What begins behind the last one taken is taken; of equal beginnings the longest comes first."""
        return F.when(e["at"] >= s["next"], F.struct((e["at"] - e["n"]).alias("next"), F.array_append(s["took"], e).alias("took"))).otherwise(s)

    begin = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<struct<at: int, n: int, mark: string>>)").alias("took"))
    taken = held.select(F.col("id").alias("_id"), F.col("_h").alias("_of"), F.aggregate("e", begin, step, lambda s: s["took"]).alias("t"))
    both = own.join(taken, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_of")), "left")
    # A text's gaps lie between the ends of what was taken and the next beginnings.
    ends = F.concat(F.array(F.lit(1)), F.transform("t", lambda e: e["at"] - e["n"]))
    begins = F.concat(F.transform("t", lambda e: e["at"]), F.array(F.length("text") + 1))
    gaps = F.zip_with(ends, begins, lambda a, b: F.col("text").substr(a, b - a))
    return both.select("id", F.when(F.col("t").isNull(), F.col("text")).otherwise(_joined(gaps, F.transform("t", lambda e: e["mark"]))).alias("masked"), F.coalesce(F.size("t"), F.lit(0)).alias("n_masked"))


def _places(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, _h, at, n, mark): all places where texts (id, _h, text) hold one of many values (value, mark; distinct).

    Values have heads, their first letters, as many as leave at most ``MOST_HEADS`` distinct ones. Texts are cut into pieces, and where a head
    stands, the runs as long as its values are looked up among them by an equi-join: rows follow places, not pairs of texts and values."""
    longest = known.agg(F.max(F.length("value"))).first()[0]
    letters = next((k for k in HEADS if small(known.select(F.left("value", F.lit(k)).alias("head")).distinct(), MOST_HEADS)), 1)
    heads = known.select(F.left("value", F.lit(letters)).alias("head"), F.length("value").alias("n")).distinct()
    sizes = [r[0] for r in heads.select(F.length("head")).distinct().collect()]  # at most ``letters`` numbers
    lengths = heads.groupBy("head").agg(F.collect_set("n").alias("ns"))
    start = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(PIECE))).alias("start")
    pieces = texts.where(F.length("text") > 0).select("id", "_h", "text", start).select("id", "_h", "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(PIECE + longest - 1)).alias("piece"))
    placed = pieces.select("id", "_h", "start", "piece", F.explode(F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(PIECE)))).alias("i"))
    one = lambda k: F.substring(F.col("piece"), F.col("i"), F.lit(k))
    begun = placed.withColumn("head", one(sizes[0]) if len(sizes) == 1 else F.explode(F.array_distinct(F.array(*map(one, sizes)))))
    runs = begun.join(F.broadcast(lengths), "head").select("id", "_h", "start", "piece", "i", F.explode("ns").alias("n")).where(F.col("i") + F.col("n") <= F.length("piece") + 1)
    asked = runs.select("id", "_h", (F.col("start") + F.col("i")).alias("at"), "n", F.substring(F.col("piece"), F.col("i"), F.col("n")).alias("value"))
    return asked.join(known, "value").select("id", "_h", "at", "n", "mark")


def _pieces(text: Column) -> Column:
    """A text as pieces (kind, text) in order: identifiers of the first kind, then of the next ones in what is left between them."""
    pieces = F.array(F.struct(F.lit(None).cast("string").alias("kind"), text.alias("text")))
    for kind, pattern in FINDERS:
        gaps = lambda p: F.transform(F.split(p["text"], pattern, -1), lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("text")))  # noqa: B023, E731
        hits = lambda p: F.transform(F.regexp_extract_all(p["text"], F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))  # noqa: B023, E731
        both = lambda p: F.filter(F.flatten(F.zip_with(gaps(p), hits(p), lambda g, h: F.array(g, h))), lambda x: x.isNotNull())  # noqa: B023, E731
        pieces = F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull() & p["text"].rlike(pattern), both(p)).otherwise(F.array(p))))  # noqa: B023
    return pieces


def _parsed(texts: DataFrame) -> DataFrame:
    """(id, pieces) of the texts that hold an identifier."""
    return texts.where(F.col("text").rlike(ANY)).select("id", _pieces(F.col("text")).alias("pieces"))


def _hits(parsed: DataFrame) -> DataFrame:
    """(id, at, kind, value) of all identifiers."""
    return parsed.select("id", F.posexplode("pieces").alias("at", "p")).where("p.kind is not null").select("id", "at", "p.kind", F.col("p.text").alias("value"))


def _numbered(hits: DataFrame) -> DataFrame:
    marks = numbered(hits.select("kind", "value").distinct(), ["kind"], "value")
    return marks.select("value", F.concat(F.lit("{"), "kind", F.lit("_"), F.col("number").cast("string"), F.lit("}")).alias("mark"))


def parse_texts(texts: DataFrame) -> DataFrame:
    """Texts (id, text) taken apart, written once to the shared folder, for a dictionary and for masking by it."""
    return stored(_parsed(texts))


def pattern_dictionary(texts: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(value, mark): numbers, phones and addresses found in the texts (``parsed``: by ``parse_texts``), numbered within their kind in order; one
    value has one number."""
    return _numbered(_hits(parse_texts(texts) if parsed is None else parsed))


def mask_patterns(texts: DataFrame, dictionary: DataFrame | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """(id, text, masked): texts (id, text; ids are distinct) with identifiers masked where they stand by marks of a dictionary (value, mark;
    by default the texts' own). An equal run of digits within a longer number is left alone. Texts are taken apart once; the pieces of
    those that hold identifiers are written to the shared folder."""
    parsed = parse_texts(texts) if parsed is None else parsed
    hits = _hits(parsed)
    marks = hits.join(_numbered(hits) if dictionary is None else dictionary, "value", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("mark", "value").alias("text")))).alias("_m"))
    # Pieces and marks in one order by place; a mark stands for the piece of its place.
    plain = F.filter(F.transform("pieces", lambda p, i: F.struct(i.alias("at"), F.when(p["kind"].isNull(), p["text"]).alias("text"))), lambda x: x["text"].isNotNull())
    whole = F.array_join(F.transform(F.array_sort(F.concat(plain, "_m")), lambda x: x["text"]), "")
    done = parsed.join(marks, "id").select("id", whole.alias("masked"))
    return texts.select("id", "text").join(done, "id", "left").select("id", "text", F.coalesce("masked", "text").alias("masked"))


def unmask_texts(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, back): marks of a dictionary (value, mark) in texts (id, masked) back to values, also where the braces were dropped. A mark without braces
    counts only whole: not behind a letter or digit, not before a digit; unknown marks stay."""
    found = F.regexp_extract_all("masked", F.lit(MARK), F.lit(0))
    each = texts.where(F.col("masked").rlike(MARK)).select("id", F.posexplode(found).alias("at", "token"))
    key = F.concat(F.lit("{"), F.regexp_replace("token", r"[{}]", ""), F.lit("}"))
    values = each.withColumn("mark", key).join(dictionary.select("mark", "value"), "mark", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", "token").alias("value")))).alias("_v"))
    return texts.select("id", "masked").join(values, "id", "left").select("id", F.when(F.col("_v").isNull(), F.col("masked")).otherwise(_joined(F.split("masked", MARK, -1), F.transform("_v", lambda v: v["value"]))).alias("back"))


def redact_injection(text: Column) -> tuple[Column, Column]:
    """The text without instruction-like phrases, and how many were blocked."""
    return F.regexp_replace(text, INJECTION, BLOCKED), F.size(F.regexp_extract_all(text, F.lit(INJECTION), F.lit(0)))


def _facts(payload: str) -> tuple[bool, int]:
    """Whether a valid payload has a forbidden key at any depth, and its longest list."""
    bad, size, left = False, 0, [json.loads(payload)]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            bad = bad or not x.keys().isdisjoint(FORBIDDEN)
            x = x.values()
        elif isinstance(x, list):
            size = max(size, len(x))
        else:
            continue
        left += [v for v in x if isinstance(v, (dict, list))]
    return bad, size


def _walked(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if p is None else _facts(p) for p in payloads], columns=["bad", "size"])


def egress_guard(payloads: DataFrame) -> DataFrame:
    """(id, verdict) of JSON payloads (id, payload): ``malformed``, ``forbidden_field`` (a key at any depth, however it is written), ``list_too_long`` (at any
    depth), ``too_large``, or ``ok``. A key that an object has twice is malformed. Each payload is judged in its own row, without a shuffle. Those that can
    hold neither, having none of the keys' letters, no escapes and too few commas, are only parsed; the others are walked in full."""
    valid = payloads.select("id", F.length("payload").alias("_n"), F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).alias("_p"))
    commas = F.col("_n") - F.length(F.replace("_p", F.lit(",")))
    open_ = reduce(Column.__or__, (F.contains(F.col("_p"), F.lit(x)) for x in ("\\", *FORBIDDEN))) | (commas >= MOST_ITEMS)
    walked = F.pandas_udf(_walked, "bad boolean, size int")
    facts = valid.withColumn("_f", walked(F.when(open_, F.col("_p"))))
    verdict = F.when(F.col("_p").isNull(), "malformed").when(F.col("_f.bad"), "forbidden_field").when(F.col("_f.size") > MOST_ITEMS, "list_too_long").when(F.col("_n") > MOST_CHARS, "too_large").otherwise("ok")
    return facts.select("id", verdict.alias("verdict"))


def audit_log(sent: DataFrame) -> DataFrame:
    """Rows for the append-only log: what left, cut to 20 000 characters."""
    return sent.withColumn("sent", F.left("sent", F.lit(SENT_CHARS)))


def audit_recent(log: DataFrame, most: int = MOST_RECENT) -> DataFrame:
    return log.orderBy(F.desc("at"), F.desc("id")).limit(most)
