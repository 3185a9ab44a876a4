"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

Score: sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), linear in the number of features of a
document. It is fitted on a bounded sample of labelled rows (``SAMPLE`` of each class at most), and scores whole texts.

Null and empty texts are scored by their (zero) features. Without labels of both classes, every score is the share of label
1, or 0.5. Repeated rows get equal scores; an empty table gives no rows. Id, language and source are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import free_name, rows_in_chunks, runs, slice_hashes, spaced_words, table, without
from evidra.llm.labelled import held_out, labelled_sample

#: Rows of each class that the model is fitted on at most; hash buckets of words; rank of the interactions.
SAMPLE, BUCKETS, RANK = 4000, 1 << 14, 8
STATS = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "bars", "non_ascii", "blank", "stops", "same_as_before", "distinct", "repeated_lines", "words_per_line", "symbol_ended", "lower_start", "all_upper_words")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics (a row a text), and sparse hashed words: text, bucket, value (unit length for each text)."""
    data, starts, ends, first, last = spaced_words(texts)
    raw_parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(raw_parts) + b" ", np.uint8)
    size = np.fromiter(map(len, raw_parts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(size + 1)))
    n_words = (last - first).astype(float)
    words = slice_hashes(data, starts, ends)
    own = np.repeat(np.arange(len(texts)), last - first)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[at[1:] - 1] - total[at[:-1]]).astype(float)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(own, weights=mask, minlength=len(texts))

    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    symbols = ((raw > 32) & (raw < 127) & ~upper & ~lower & ~((raw >= 48) & (raw <= 57)) & ~np.isin(raw, np.frombuffer(b".,!|'\"-", np.uint8)))
    letters = np.concatenate(([0], np.cumsum(lower | (raw >= 128))))
    capitals = np.concatenate(([0], np.cumsum(upper)))
    chars, n = np.maximum(size, 1.0), np.maximum(n_words, 1.0)
    last_byte = raw[ends - 1] if len(ends) else raw[:0]
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    # Distinct words and their counts.
    order = np.lexsort((words, own))
    sorted_words, sorted_own = words[order], own[order]
    new = np.ones(len(words), bool)
    new[1:] = (sorted_words[1:] != sorted_words[:-1]) | (sorted_own[1:] != sorted_own[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(words)))
    text, bucket = sorted_own[head], (sorted_words[head] & np.uint64(BUCKETS - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(texts)))
    value = value / norm[text] if len(text) else value
    # Lines.
    low, high = runs(raw != 10) if len(raw) else (raw[:0], raw[:0])
    lines = per_text(raw == 10) + 1
    line_hash = slice_hashes(raw, low, high)
    line_own = np.searchsorted(at, low, "right") - 1
    pairs = np.unique(np.stack((line_own.astype(np.uint64), line_hash)), axis=1) if len(low) else np.zeros((2, 0), np.uint64)
    distinct_lines = np.bincount(pairs[0].astype(np.int64), minlength=len(texts))
    full_lines = np.bincount(line_own, minlength=len(texts))
    stats = np.stack(
        [
            np.log1p(size), np.log1p(n_words), per_word((ends - starts).astype(float)) / n, per_text(upper) / chars, per_text((raw >= 48) & (raw <= 57)) / chars, per_text(symbols) / chars,
            per_text(raw == 33) / n, per_text(raw == 124) / n, per_text(raw >= 128) / chars, per_text((raw == 32) | (raw == 10)) / chars, per_text(raw == 46) / n, per_word(same) / n,
            np.bincount(text, minlength=len(texts)) / n, 1 - distinct_lines / np.maximum(full_lines, 1), np.log1p(n_words / lines), per_word(np.isin(last_byte, np.frombuffer(b"*#$%&!|", np.uint8))) / n,
            per_word((raw[starts] >= 97) & (raw[starts] <= 122)) / n if len(starts) else n_words, per_word((letters[ends] == letters[starts]) & (capitals[ends] - capitals[starts] > 1)) / n if len(starts) else n_words,
        ],
        axis=1,
    )
    return stats, text, bucket, value


@dataclass
class Machine:
    """A fitted factorisation machine; features are the buckets, then the standardised statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def raw(self, stats: np.ndarray, text: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        n = len(stats)
        dense = np.clip((stats - self.mean) / self.spread, -6, 6)
        dw, dv = self.weights[BUCKETS:], self.factors[BUCKETS:]
        linear = dense @ dw + np.bincount(text, weights=self.weights[bucket] * value, minlength=n)
        v = self.factors[bucket] * value[:, None]
        out = self.bias + linear
        for f in range(self.factors.shape[1]):
            total = np.bincount(text, weights=v[:, f], minlength=n) + dense @ dv[:, f]
            squares = np.bincount(text, weights=v[:, f] ** 2, minlength=n) + (dense**2) @ dv[:, f] ** 2
            out += 0.5 * (total**2 - squares)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts)), -30, 30)))


def fit(stats: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the logistic loss, classes weighted by the root of their shares. ``rows``: bucket, value."""
    random = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    mean, spread = (stats.mean(0), stats.std(0) + 1e-3) if len(y) else (np.zeros(len(STATS)), np.ones(len(STATS)))
    size = BUCKETS + len(STATS)
    machine = Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(size), np.zeros((size, RANK)), mean, spread)
    if not len(y) or share in (0, 1):
        if not len(y):
            machine.bias = 0.0
        return machine
    machine.factors = random.normal(0, 0.01, (size, RANK))
    dense = np.clip((stats - mean) / spread, -6, 6)
    square_w, square_v, square_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    places = np.arange(BUCKETS, size)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for k in range(0, len(y), 64):
            batch = order[k : k + 64]
            bucket = np.concatenate([rows[i][0] for i in batch] + [np.zeros(0, np.int64)]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in batch] + [np.zeros(0)])
            text = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            out = machine.raw(stats[batch], text, bucket, value)
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[batch]) / len(batch)
            index = np.concatenate((bucket, np.tile(places, len(batch))))
            own = np.concatenate((text, np.repeat(np.arange(len(batch)), len(places))))
            x = np.concatenate((value, dense[batch].ravel()))
            total = np.stack([np.bincount(own, weights=machine.factors[index, f] * x, minlength=len(batch)) for f in range(RANK)], 1)
            used, place = np.unique(index, return_inverse=True)
            gw = np.bincount(place, weights=error[own] * x) + decay * machine.weights[used]
            gv = np.stack([np.bincount(place, weights=error[own] * (x * total[own, f] - machine.factors[index, f] * x * x)) for f in range(RANK)], 1) + decay * machine.factors[used]
            square_w[used] += gw**2
            square_v[used] += gv**2
            square_b += error.sum() ** 2
            machine.weights[used] -= rate * gw / np.sqrt(square_w[used])
            machine.factors[used] -= rate * gv / np.sqrt(square_v[used])
            machine.bias -= rate * error.sum() / np.sqrt(square_b)
    return machine


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in rows_in_chunks(batches, "_text"):
        stats, text, bucket, value = features(texts)
        at = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
        dense = pa.ListArray.from_arrays(pa.array((np.arange(len(texts) + 1) * len(STATS)).astype(np.int32)), pa.array(stats.ravel()))
        yield pa.RecordBatch.from_arrays([rows.column(1), dense, *lists], ["y", "stats", "buckets", "amounts"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on the features of a bounded sample; features are made by Spark's tasks, and only these come to the driver, as Arrow
    columns (no row objects)."""
    sample = labelled_sample(docs, labels, label, folds, fold, limit, id_col, text_col)
    rows = sample.mapInArrow(_featured, "y int, stats array<double>, buckets array<int>, amounts array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit(np.zeros((0, len(STATS))), [], np.zeros(0))
    y, (stats, buckets, amounts) = rows["y"].to_numpy(), (rows[name].combine_chunks() for name in ("stats", "buckets", "amounts"))
    stats = stats.flatten().to_numpy().reshape(-1, len(STATS))
    order = np.lexsort((*stats.T[::-1], y))  # tasks end in any order
    at, bucket, amount = buckets.offsets.to_numpy(), buckets.values.to_numpy(), amounts.values.to_numpy()
    return fit(stats[order], [(bucket[at[i] : at[i + 1]], amount[at[i] : at[i + 1]]) for i in order.tolist()], y[order].astype(float))


def score_documents(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each text; a column that is called like the score gives way to it. No shuffle; the
    model (about 1 MB) goes with the tasks."""
    kept, text = without(docs.columns, [out_col]), free_name([*docs.columns, out_col], "_text")
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_in_chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(model.value.score(texts))], [*kept, out_col])

    rows = docs.select(*(docs[c] for c in kept), docs[text_col].alias(text))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}`{out_col}` double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a quality score for every document; labels of the held-out fold aren't learnt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
