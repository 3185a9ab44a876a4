"""License scans with a positional rare-token index, by DataFrame functions alone.

A template is a sequence of words with a label and a mandatory key phrase at a place in it. Document frequencies of the
key phrases' words over all documents tell each template's rarest key words. A file's occurrences of such words are
looked up in the templates' postings; each gives the place where its template would begin, places that agree are
intersected, the key phrase is verified word by word, and the share of template words at their relative positions is the coverage.
A base template (its key phrase is all of it) counts each place; another one labels a file from ``LEAST_COVERAGE`` on.

Everything happens within a row; only counts of a few words are shuffled. Null text is empty: no words, no labels
(empty strings), null places, score 0. Repeated rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import table


@dataclass(frozen=True)
class Template:
    """``key`` is the first word's place and the number of words of the mandatory phrase; base templates are all key."""

    label: str
    text: str
    key: tuple[int, int] | None = None

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def span(self) -> tuple[int, int]:
        return self.key or (0, len(self.words))


# The base phrases and their labels.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
OWN = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", (0, 7)),
    Template("apache-2", "licensed under the apache license version 2 0", (3, 2)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", (0, 5)),
    Template("gpl", "under the terms of the gnu general public license", (5, 4)),
    Template("lgpl", "under the terms of the gnu lesser general public license", (5, 5)),
    Template("mpl", "subject to the terms of the mozilla public license", (6, 3)),
    Template("cc-by", "licensed under a creative commons attribution license", (3, 3)),
    Template("cc-by-sa", "licensed under cc by sa", (2, 3)),
    Template("proprietary", "all rights reserved", (0, 3)),
)
LEAST_COVERAGE = 0.7
#: Rarest key words that a template is indexed by.
INDEX_WORDS = 2


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def key_words(template: Template) -> list[str]:
    at, n = template.span
    return template.words[at : at + n]


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """Documents that hold each word: a count over all rows; as many numbers as the fixed vocabulary reach the driver."""
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rarest(template: Template, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The template's index words (highest inverse frequency first) and their places in it."""
    at, _ = template.span
    placed = [(w, at + k) for k, w in enumerate(key_words(template))]
    return sorted(dict(reversed(placed)).items(), key=lambda x: (frequency.get(x[0], 0), x[1]))[:INDEX_WORDS]


def _places(template: Template, index: list[tuple[str, int]], words: Column, hits: Column) -> Column:
    """Beginnings that all the template's index words agree on, with the key phrase verified."""
    begins = [F.transform(F.filter(hits, lambda h: h["word"] == w), lambda h: h["place"] - at) for w, at in index]
    agreed = begins[0]
    for more in begins[1:]:
        agreed = F.array_intersect(agreed, more)
    at, n = template.span
    key = F.array(*map(F.lit, key_words(template)))
    return F.filter(F.filter(agreed, lambda s: s >= 0), lambda s: F.slice(words, s + at + 1, F.lit(n)) == key)


def _coverage(template: Template, words: Column, places: Column) -> Column:
    """Largest share of template words at their places."""
    whole = F.array(*map(F.lit, template.words))
    share = lambda s: F.aggregate(F.zip_with(F.slice(words, s + 1, F.lit(len(template.words))), whole, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    return F.coalesce(F.array_max(F.transform(places, share)), F.lit(0)) / len(template.words)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of words, places and labels of base phrases, all labels, and a score (the best coverage)."""
    templates = [*BASE, *OWN]
    frequency = document_frequencies(docs, sorted({w for t in templates for w in key_words(t)}), text_col)
    index = {t: rarest(t, frequency) for t in templates}
    rare = F.array(*map(F.lit, sorted({w for places in index.values() for w, _ in places})))
    none = F.array().cast("array<struct<place:int,word:string>>")
    split = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("words"))
    looked_up = split.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        "words",
        F.when(F.arrays_overlap("words", rare), F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda h: F.array_contains(rare, h["word"]))).otherwise(none).alias("hits"),
    )
    placed = looked_up.select(id_col, "n_words", "words", *(F.when(F.size("hits") > 0, _places(t, index[t], F.col("words"), F.col("hits"))).otherwise(F.array().cast("array<int>")).alias(f"p{k}") for k, t in enumerate(templates)))
    base = range(len(BASE))
    every = F.concat(*(F.col(f"p{k}") for k in base))
    found = placed.select(id_col, "n_words", every.alias("places"), *(F.when(F.size(f"p{k}") > 0, _coverage(t, F.col("words"), F.col(f"p{k}"))).otherwise(F.lit(0.0)).alias(f"c{k}") for k, t in enumerate(templates)))
    least = lambda k: 1.0 if k in base else LEAST_COVERAGE
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.col(f"c{k}") >= least(k), F.lit(templates[k].label)) for k in some)), lambda x: x.isNotNull()))), ",")
    return found.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(range(len(templates))).alias("labels"),
        F.greatest(*(F.col(f"c{k}") for k in range(len(templates)))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: license phrases of every document."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    templates = [*BASE, *OWN]

    def places(t: Template) -> str:
        at, _ = t.span
        return "list_filter(range(len(w)), lambda i: " + " AND ".join(f"coalesce(w[i + {at + k + 1}] = '{x}', false)" for k, x in enumerate(key_words(t))) + ")"

    def coverage(t: Template, k: int) -> str:
        share = " + ".join(f"CASE WHEN w[i + {j + 1}] = '{x}' THEN 1 ELSE 0 END" for j, x in enumerate(t.words))
        return f"coalesce(list_max(list_transform(p{k}, lambda i: {share})), 0) / {len(t.words)}.0::DOUBLE"

    n = range(len(templates))
    least = [1.0 if k < len(BASE) else LEAST_COVERAGE for k in n]
    labels = lambda some: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN c{k} >= {least[k]} THEN '{templates[k].label}' END" for k in some) + "], lambda x: x IS NOT NULL))), ',')"
    return (
        f"WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents), "
        f"p AS (SELECT doc_id, w, {', '.join(f'{places(t)} AS p{k}' for k, t in enumerate(templates))} FROM d), "
        f"c AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_concat(list_concat(p0, p1), p2) AS places, {', '.join(f'{coverage(t, k)} AS c{k}' for k, t in enumerate(templates))} FROM p) "
        f"SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, {labels(range(len(BASE)))} AS base_labels, {labels(n)} AS labels, greatest({', '.join(f'c{k}' for k in n)}) AS score FROM c"
    )


SQL = _sql()
