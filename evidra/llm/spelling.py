"""Grouping of spelling variants by one-edit neighbourhoods over a reduced alphabet.

Words are counted over all whole texts. Letters are hashed to a few symbols, and every word of the vocabulary is read as a reduced
word. Its full one-edit neighbourhood (itself, and every symbol deleted, replaced or inserted) is generated as 64-bit codes, which meet the
codes of the reduced vocabulary; since one edit of a word is at most one edit of its reduced form, no near pair is lost. What meets
is verified on the original strings. The nearest frequent word is a word's form, and forms lead to roots by pointer doubling.

The alphabet has as many symbols as its sixth power needs to reach the size of the vocabulary (at least ``LEAST_SYMBOLS``), so that even the
shortest words are spread and candidates stay in proportion to neighbourhoods. Codes that more than ``CROWD`` words share are
reduced again with the square of the alphabet, for their words and for the neighbourhoods that meet them only.

Cases. Null and empty texts have no words; a null id counts as empty text. Runs are maximal, of any length: the neighbourhood of a
word of n letters takes memory in proportion to n and the symbols (codes come from prefixes and suffixes, no variant is spelled out), and is
generated in pieces of ``PIECE`` codes. Repeated rows count as often as they occur; an empty table gives no rows; other columns
play no part. Ties between near words go to the smallest in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, mix64, rows_in_chunks, table

#: Letters of words; shortest words and fewest occurrences of the vocabulary; times a form must outnumber its word.
LETTERS, LEAST_LETTERS, LEAST_COUNT, TIMES = "A-Za-zÀ-ÿ", 6, 5, 5
#: Occurrences of which one in so many lacks a letter, by the checksum of id and word.
FLAWS = 199
LEAST_SYMBOLS, CROWD = 4, 256
#: Distinct words held by a counting task before it passes them on; codes generated at a time.
HELD, PIECE = 200_000, 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 2**64))
_STEP = np.uint64(0xD1B54A32D192ED03)


def counts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, flaws: int | None = FLAWS) -> DataFrame:
    """word, n over all texts of words with ``least`` letters or more. With ``flaws``, a run whose crc32 of ``<id>:<run>`` it divides loses the
    letter at that checksum modulo its length (before its length counts)."""
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall  # a shorter run has no such match, a longer one is matched whole

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for rows, texts in rows_in_chunks(batches, "text"):
            for name, text in zip(rows.column("id").to_pylist(), texts):
                seed, own = zlib.crc32(f"{name}:".encode()), Counter()
                for word, n in Counter(find(text)).items():
                    own[word.lower() if word.isascii() else word.encode().lower().decode()] += n
                for word, n in own.items():
                    if flaws and (h := zlib.crc32(word.encode(), seed)) % flaws == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    plain = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].alias("text"))
    return plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(words: list[str], symbols: int) -> np.ndarray:
    """Symbols from 1 of words of one length, a row a word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return (mix64(points.astype(np.uint64) + _STEP) % np.uint64(symbols) + np.uint64(1)).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _code(value: np.ndarray, length: int) -> np.ndarray:
    return mix64(value + np.uint64(length) * _STEP).view(np.int64)


def reduced_codes(words: list[str], symbols: int) -> np.ndarray:
    """Codes of the reduced forms of words of one length."""
    with np.errstate(over="ignore"):
        s = _symbols(words, symbols)
        return _code((s * _powers(s.shape[1])[:-1]).sum(1, dtype=np.uint64), s.shape[1])


def neighbour_codes(words: list[str], symbols: int) -> Iterator[np.ndarray]:
    """Codes of the reduced forms themselves and of all one-edit variants, for words of one length; a block of rows a word, repeats possible.
    A variant's value follows from sums before and after the edit."""
    with np.errstate(over="ignore"):
        s = _symbols(words, symbols)
        n, power = s.shape[1], _powers(s.shape[1] + 1)
        before = np.concatenate((np.zeros((len(words), 1), np.uint64), np.cumsum(s * power[:n], 1, dtype=np.uint64)), 1)
        all_ = before[:, -1:]
        yield _code(all_, n)
        yield _code(before[:, :-1] + (all_ - before[:, 1:]) * BACK, n - 1)  # deleted
        without, shifted = all_ - s * power[:n], before + (all_ - before) * BASE
        for c in range(1, symbols + 1):
            yield _code(without + np.uint64(c) * power[:n], n)  # replaced (by itself: the word)
            yield _code(shifted + np.uint64(c) * power[: n + 1], n + 1)  # inserted


def _by_length(words: list[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.values()


def with_codes(words: DataFrame, symbols: int) -> DataFrame:
    """Words (word, n) with the ``code`` of their reduced form."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = {w: i for i, w in enumerate(batch.column("word").to_pylist())}
            codes = np.zeros(batch.num_rows, np.int64)
            for group in _by_length(list(order)):
                codes[[order[w] for w in group]] = reduced_codes(group, symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], ["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def neighbourhoods(words: DataFrame, symbols: int) -> DataFrame:
    """(word, code): the codes of each word's one-edit neighbourhood over the reduced alphabet, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _by_length(batch.column("word").to_pylist()):
                share = max(1, PIECE // (2 * (len(group[0]) + 1) * (symbols + 1)))
                for at in range(0, len(group), share):
                    some = group[at : at + share]
                    codes = np.sort(np.concatenate(list(neighbour_codes(some, symbols)), 1), 1)
                    first = np.concatenate((np.ones((len(some), 1), bool), codes[:, 1:] != codes[:, :-1]), 1)
                    own = pa.array(some, pa.string()).take(pa.array(np.repeat(np.arange(len(some)), first.sum(1))))
                    flat = pa.array(codes[first])
                    for k in range(0, len(flat), PIECE):
                        yield pa.RecordBatch.from_arrays([own[k : k + PIECE], flat[k : k + PIECE]], ["word", "code"])

    return words.select("word").mapInArrow(run, "word string, code long")


def near_words(vocabulary: DataFrame, symbols: int, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words of ``vocabulary`` (word, n; checkpointed) that differ by exactly one edit."""
    held = checkpointed(with_codes(vocabulary, symbols))
    crowded = checkpointed(held.groupBy("code").agg(F.count("*").alias("words")).where(F.col("words") > crowd).select("code"))
    around = neighbourhoods(vocabulary, symbols)
    target = lambda df: df.select("code", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = around.join(target(held.join(crowded, "code", "left_anti")), "code").select("word", "near", "near_n")
    if not crowded.isEmpty():
        again = around.join(crowded, "code", "left_semi").select("word").distinct()
        fine = symbols * symbols
        met = met.unionByName(neighbourhoods(again, fine).join(target(with_codes(held.join(crowded, "code", "left_semi"), fine)), "code").select("word", "near", "near_n"))
    return met.where(F.levenshtein("word", "near", 1) == 1)


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) for words with a form: forms (word, form) followed to the last. Each step at least multiplies the count by ``TIMES``, so
    chains are no longer than the logarithm of ``most``, the largest count; each round doubles what is followed."""
    now, depth = forms.select("word", F.col("form").alias("root")), max(1, ceil(log(max(most, TIMES), TIMES)))
    for _ in range(max(1, ceil(log(depth, 2)) if depth > 1 else 1)):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = checkpointed(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return now


def group_variants(counts: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n) that occur ``least_count`` times or more."""
    vocabulary = checkpointed(counts.where(F.col("n") >= least_count))
    size, most = vocabulary.agg(F.count("*"), F.max("n")).first()
    symbols = max(LEAST_SYMBOLS, ceil(size ** (1 / LEAST_LETTERS)))
    best = near_words(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    enough = -F.col("best.n") >= F.col("n") * times
    known = checkpointed(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")))
    last = roots(known.where("form is not null"), int(most or 1))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: forms and roots of all words of the documents' vocabulary."""
    return group_variants(counts_of(table(spark, sf_dir, "documents").select("doc_id", "text")))
