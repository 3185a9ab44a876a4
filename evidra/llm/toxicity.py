"""Toxic spans by a linear-chain conditional random field, and scores of documents from its marginals.

Labels mark documents; tokens get theirs from them. Of all features (a word, or its first 4 to 9 bytes), those ``LEAST_RATIO``
times as frequent in toxic as in clean documents are candidates; a greedy cover keeps the ones that explain most toxic documents not
explained so far, so words that only go along (a copied text's) are left. Tokens with a kept feature are the labelled
toxic tokens, if in a toxic document. A two-state chain over hashed features is fitted to all tokens of the sampled documents,
in runs of ``WINDOW`` tokens, by its likelihood.

Scoring runs forward and backward over every token of the whole text. A chain of two states has one ratio a token, each step
is a linear-fractional map of it, and maps compose; so all documents of a chunk advance in equal blocks. The
marginals give spans (code points of offending words) and the evidence for the document's score: the expected
number of toxic tokens in all and beyond the surest one, the surest one's marginal and odds, and their share.

Null and empty texts have no tokens and get the score of no evidence. Without labels of both classes all scores are 0. Of equal sampled
texts with both labels, the toxic one counts. Repeated rows get equal scores; an empty table gives no rows. Id, language and source
are no inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, free_name, joined_bytes, lower_ascii, rows_in_chunks, runs, slice_hashes, table, without
from evidra.llm.labelled import held_out, labelled_sample

#: Rows of each class that the model is fitted on at most; hash buckets of features; tokens in a training run.
SAMPLE, BUCKETS, WINDOW = 4000, 1 << 17, 32
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A kept feature explains at least so many documents more; how many times as frequent it is in toxic documents.
LEAST_SUPPORT, LEAST_RATIO = 4, 8
#: Share of toxic documents that a feature needs to be kept beyond the cover, and share of its documents that another one has at most.
OWN_SHARE, GOES_ALONG = 0.01, 0.8
BLOCK = 64
#: Columns of evidence, the last one constant.
EVIDENCE = 6


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs of lower-cased texts: feature hashes (a row a token; 0 where the word is shorter than the prefix), text,
    and code points where it starts and ends in its text."""
    data, at = joined_bytes(texts)
    data = lower_ascii(data)
    starts, ends = runs(((data >= 97) & (data <= 122)) | (data >= 128))
    hashes = [slice_hashes(data, starts, ends)]
    for k in PREFIXES:
        hashes.append(np.where(ends - starts > k, slice_hashes(data, starts, np.minimum(ends, starts + k)) ^ np.uint64(k), np.uint64(0)))
    text = np.searchsorted(at, starts, "right") - 1
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    base = point[at[:-1]][text] if len(starts) else starts
    return np.stack(hashes, 1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.uint64), text, point[starts] - base, point[ends] - base


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each feature; absent ones share bucket 0, whose weight stays 0."""
    return np.where(hashes == 0, 0, 1 + (hashes % np.uint64(BUCKETS - 1))).astype(np.int64)


@dataclass
class Chain:
    """Weights of features for the toxic state (its odds against clean), of transitions, and of the document's score."""

    features: np.ndarray
    bias: float
    moves: np.ndarray  # log potentials [from, to], with clean-clean 0
    aggregate: np.ndarray  # weights of the columns of evidence()

    def odds(self, hashes: np.ndarray) -> np.ndarray:
        return self.bias + self.features[buckets(hashes)].sum(1)

    def marginals(self, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each token."""
        n = len(hashes)
        if not n:
            return np.zeros(0)
        unary = np.exp(np.clip(self.odds(hashes), -30, 30))
        first = np.ones(n, bool)
        first[1:] = text[1:] != text[:-1]
        a = np.exp(self.moves)
        # Forward: ratio r (toxic to clean) goes to unary * (r a11 + a01) / (r a10 + a00); at a text's start it is unary.
        ahead = self._scan(unary * np.where(first, 0, a[1, 1]), unary * np.where(first, 1, a[0, 1]), np.where(first, 0, a[1, 0]), np.where(first, 1, a[0, 0]), 1.0)
        # Backward: ratio of what follows; 1 at a text's end.
        last = np.append(first[1:], True)[::-1]
        after = np.append(unary[1:], 1.0)[::-1]
        back = self._scan(np.where(last, 0, after * a[1, 1]), np.where(last, 1, a[1, 0]), np.where(last, 0, after * a[0, 1]), np.where(last, 1, a[0, 0]), 1.0)[::-1]
        ratio = ahead * back
        return ratio / (1 + ratio)

    @staticmethod
    def _scan(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, start: float) -> np.ndarray:
        """All x_t = (p x + q) / (r x + s) of the x before it, by composing the maps of equal blocks side by side."""
        n = len(p)
        blocks = -(-n // BLOCK)
        grid = np.zeros((4, blocks * BLOCK))
        grid[0], grid[3] = 1, 1
        for k, x in enumerate((p, q, r, s)):
            grid[k, :n] = x
        grid = np.ascontiguousarray(grid.reshape(4, blocks, BLOCK).transpose(2, 0, 1))
        whole = np.zeros((4, blocks))
        whole[0], whole[3] = 1, 1
        for step in grid:
            whole = np.stack((step[0] * whole[0] + step[1] * whole[2], step[0] * whole[1] + step[1] * whole[3], step[2] * whole[0] + step[3] * whole[2], step[2] * whole[1] + step[3] * whole[3]))
            whole /= np.abs(whole).max(0)
        entry, x = np.empty(blocks), start
        for k, (wp, wq, wr, ws) in enumerate(whole.T.tolist()):
            entry[k] = x
            x = (wp * x + wq) / (wr * x + ws)
        out = np.empty((BLOCK, blocks))
        for k, step in enumerate(grid):
            entry = (step[0] * entry + step[1]) / (step[2] * entry + step[3])
            out[k] = entry
        return out.T.ravel()[:n]

    def evidence(self, p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        expected, count, most = np.bincount(text, weights=p, minlength=n), np.bincount(text, minlength=n), np.zeros(n)
        np.maximum.at(most, text, p)
        return np.stack((np.log1p(expected), most, expected / np.maximum(count, 1), np.minimum(8, -np.log1p(-np.minimum(most, 1 - 1e-9))) / 4, np.log1p(expected - most), np.ones(n)), 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.aggregate, -30, 30)))


def fit_chain(words: np.ndarray, places: np.ndarray, tags: np.ndarray, epochs: int = 10, rate: float = 0.4, decay: float = 1e-5, seed: int = 3, batch: int = 512) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximise the likelihood of tagged runs. ``words``: buckets of each word's features; ``places``: the words of each run (runs x
    WINDOW); ``tags``: 1 toxic, 0 clean, -1 beyond a run's end."""
    random = np.random.default_rng(seed)
    w, moves, bias = np.zeros(BUCKETS), np.zeros((2, 2)), -3.0
    sw, sm, sb = np.full(BUCKETS, 1e-3), np.full((2, 2), 1e-3), 1e-3
    for _ in range(epochs):
        order = random.permutation(len(tags))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            at, tag = words[places[some]], tags[some]
            live, a = tag >= 0, np.exp(moves)
            odds = np.exp(np.where(live, np.clip(bias + w[at].sum(2), -30, 30), 0.0))
            # Ratios (toxic to clean) of what is up to a token, and of what follows it; see Chain.marginals.
            ahead, back = odds.copy(), np.ones_like(odds)
            for t in range(1, WINDOW):
                x = ahead[:, t - 1]
                ahead[:, t] = np.where(live[:, t], odds[:, t] * (x * a[1, 1] + a[0, 1]) / (x * a[1, 0] + a[0, 0]), x)
            for t in range(WINDOW - 2, -1, -1):
                x = odds[:, t + 1] * back[:, t + 1]
                back[:, t] = np.where(live[:, t + 1], (a[1, 0] + x * a[1, 1]) / (a[0, 0] + x * a[0, 1]), 1.0)
            ratio = ahead * back
            error = np.where(live, ratio / (1 + ratio) - (tag == 1), 0) / len(some)
            both, x, y = live[:, 1:], ahead[:, :-1], odds[:, 1:] * back[:, 1:]
            pairs = np.stack((np.full_like(x, a[0, 0]), a[0, 1] * y, a[1, 0] * x, a[1, 1] * x * y))
            gm = ((pairs / pairs.sum(0)) * both).sum((1, 2)).reshape(2, 2) / len(some)
            np.subtract.at(gm, (tag[:, :-1][both], tag[:, 1:][both]), 1 / len(some))
            gm[0, 0] = 0
            g = np.bincount(at.ravel(), weights=np.repeat(error.ravel(), at.shape[2]), minlength=BUCKETS) + decay * w
            g[0] = 0
            gb = error.sum()
            sw += g * g
            sm += gm * gm
            sb += gb * gb
            w -= rate * g / np.sqrt(sw)
            moves -= rate * 0.5 * gm / np.sqrt(sm)
            bias -= rate * gb / np.sqrt(sb)
    return w, float(bias), moves


def fit_aggregate(evidence: np.ndarray, y: np.ndarray, steps: int = 2000, rate: float = 0.5) -> np.ndarray:
    """Logistic regression, as if one in five documents were toxic."""
    share = y.mean()
    weight = np.where(y == 1, 0.2 / share, 0.8 / (1 - share)) / len(y)
    a, square = np.zeros(EVIDENCE), np.full(EVIDENCE, 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(evidence @ a, -30, 30)))
        g = evidence.T @ ((p - y) * weight) + 1e-5 * a
        square += g * g
        a -= rate * g / np.sqrt(square)
    return a


def _each_feature(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (feature) of each text, with its label."""
    for rows, texts in rows_in_chunks(batches, "_text", 200_000):
        hashes, text, _, _ = tokens(texts)
        y = rows.column(1).to_numpy(zero_copy_only=False)
        kept = np.repeat(text, hashes.shape[1]), hashes.ravel()
        pairs = np.unique(np.stack((kept[0].astype(np.uint64), kept[1])), axis=1) if len(text) else np.zeros((2, 0), np.uint64)
        pairs = pairs[:, pairs[1] != 0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(y[pairs[0].astype(np.int64)].astype(np.int32))], ["feature", "y"])


def _holding(candidates: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_in_chunks(batches, "_text"):
            hashes, text, _, _ = tokens(texts)
            found: list[set[int]] = [set() for _ in texts]
            line, column = np.nonzero(np.isin(hashes, candidates))
            for t, h in zip(text[line].tolist(), hashes[line, column].view(np.int64).tolist()):
                found[t].add(h)
            yield pa.RecordBatch.from_arrays([pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], ["features"])

    return run


def cover(features: np.ndarray, docs: np.ndarray, n_docs: int, worth: np.ndarray) -> np.ndarray:
    """Features (by number) that explain the most documents not explained by those before, each document counting by the feature's
    worth; then frequent ones that no kept feature mostly goes with (words that only go along with one, as in copies, aren't kept).
    ``features`` and ``docs``: which document holds which feature, each pair once."""
    support = np.bincount(features, minlength=len(worth))
    along, open_docs, kept = np.zeros(len(worth), bool), np.ones(n_docs, bool), []

    def keep(f: int) -> np.ndarray:
        held = np.zeros(n_docs, bool)
        held[docs[features == f]] = True
        along[np.bincount(features[held[docs]], minlength=len(worth)) >= GOES_ALONG * support] = True
        along[f] = True
        kept.append(f)
        return held

    while True:
        rest = np.bincount(features[open_docs[docs]], minlength=len(worth))
        best = int(np.argmax(rest * worth))
        if rest[best] < (LEAST_SUPPORT if kept else 1):
            break
        open_docs &= ~keep(best)
    for f in np.argsort(-support * worth, kind="stable").tolist():
        if not along[f] and support[f] >= max(LEAST_SUPPORT, OWN_SHARE * n_docs):
            keep(f)
    return np.array(kept, np.int64)


def _tagged(lexicon: np.ndarray, known: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The training runs of each text: places of their words among all known ones, and whether a word has a kept feature in a toxic
    text. A run is a row, so that no row grows with its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_in_chunks(batches, "_text"):
            hashes, text, _, _ = tokens(texts)
            tags = np.isin(hashes, lexicon).any(1) & (rows.column(1).to_numpy(zero_copy_only=False)[text] == 1)
            words = np.searchsorted(known.value, hashes[:, 0].view(np.int64))
            places, marks = training_runs(words, tags, np.searchsorted(text, np.arange(len(texts) + 1)))
            at = pa.array(np.arange(0, places.size + 1, WINDOW).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (places, marks)], ["places", "tags"])

    return run


def _vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of each word's features."""
    for _, texts in rows_in_chunks(batches, "_text"):
        hashes = tokens(texts)[0]
        hashes = hashes[np.unique(hashes[:, 0], return_index=True)[1]]
        at = pa.array(np.arange(0, hashes.size + 1, hashes.shape[1]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0].copy().view(np.int64)), pa.ListArray.from_arrays(at, pa.array(buckets(hashes).ravel().astype(np.int32)))], ["word", "places"])


def training_runs(words: np.ndarray, tags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (``at``: where each begins, plus the end) cut into consecutive runs of WINDOW tokens, the last one filled with tag -1."""
    n = np.diff(at)
    runs_each = -(-n // WINDOW)
    first = np.cumsum(runs_each) - runs_each
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(words)) - (at[:-1] - at[0])[text]
    row = first[text] + inside // WINDOW
    places, marks = np.zeros((int(runs_each.sum()), WINDOW), np.int32), np.full((int(runs_each.sum()), WINDOW), -1, np.int8)
    places[row, inside % WINDOW], marks[row, inside % WINDOW] = words, tags
    return places, marks


def _evidence(chain: Chain) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_in_chunks(batches, "_text"):
            hashes, text, _, _ = tokens(texts)
            e = chain.evidence(chain.marginals(hashes, text), text, len(texts))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, e.size + 1, EVIDENCE).astype(np.int32)), pa.array(e.ravel())), rows.column(1)], ["evidence", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, fold: int = 1, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on a bounded sample of labelled rows. Counts are Spark aggregations; candidate features, the sample's runs as numbers of words and
    a few figures a document come to the driver, as Arrow columns (no row objects)."""
    sample = checkpointed(labelled_sample(docs, labels, label, folds, fold, limit, id_col, text_col).groupBy("_text").agg(F.max("y").alias("y")))
    none = Chain(np.zeros(BUCKETS), -30.0, np.zeros((2, 2)), np.array([0.0] * (EVIDENCE - 1) + [-30.0]))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return none
    counted = sample.mapInArrow(_each_feature, "feature long, y int").groupBy("feature").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    ratio = (F.col("toxic") / sizes[1]) / ((F.col("n") - F.col("toxic") + 0.5) / (sizes[0] + 0.5))
    support = min(LEAST_SUPPORT, max(1, sizes[1] // 8))
    candidates = counted.where(F.col("toxic") >= support).select("feature", F.log(ratio).alias("worth")).where(F.col("worth") >= float(np.log(LEAST_RATIO))).orderBy("feature").toArrow()
    if not candidates.num_rows:
        return none
    names, worth = candidates["feature"].to_numpy(), candidates["worth"].to_numpy()
    holding = sample.where("y = 1").mapInArrow(_holding(names.view(np.uint64)), "features array<long>").toArrow()["features"].combine_chunks()
    held = np.searchsorted(names, holding.flatten().to_numpy())
    lexicon = names[cover(held, np.repeat(np.arange(len(holding)), np.diff(holding.offsets.to_numpy())), len(holding), worth)].view(np.uint64)
    words = sample.mapInArrow(_vocabulary, "word long, places array<int>").groupBy("word").agg(F.first("places").alias("places")).orderBy("word").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(words["word"].to_numpy())
    tagged = sample.mapInArrow(_tagged(lexicon, known), "places array<int>, tags array<tinyint>").orderBy(F.xxhash64("places", "tags")).toArrow()  # tasks end in any order
    known.unpersist()
    runs_of, marks = (tagged[name].combine_chunks().flatten().to_numpy().reshape(-1, WINDOW) for name in ("places", "tags"))
    chain = Chain(*fit_chain(words["places"].combine_chunks().flatten().to_numpy().reshape(-1, 1 + len(PREFIXES)), runs_of, marks), none.aggregate)
    seen = sample.mapInArrow(_evidence(chain), "evidence array<double>, y int").toArrow()
    chain.aggregate = fit_aggregate(seen["evidence"].combine_chunks().flatten().to_numpy().reshape(-1, EVIDENCE), seen["y"].to_numpy().astype(float))
    return chain


def score_documents(docs: DataFrame, chain: Chain, text_col: str = "text", out_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """All columns of ``docs``, the score of each text and its offending spans (code points from, to; marginals of 0.5 and more).
    Columns that are called like these two give way to them."""
    kept, text_name = without(docs.columns, [out_col, spans_col]), free_name([*docs.columns, out_col, spans_col], "_text")
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for rows, texts in rows_in_chunks(batches, text_name):
            hashes, text, begin, end = tokens(texts)
            p = model.value.marginals(hashes, text)
            spans: list[list[dict]] = [[] for _ in texts]
            for k in np.flatnonzero(p >= 0.5).tolist():
                spans[text[k]].append({"start": int(begin[k]), "end": int(end[k])})
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(model.value.score(model.value.evidence(p, text, len(texts)))), pa.array(spans, kind)], [*kept, out_col, spans_col])

    rows = docs.select(*(docs[c] for c in kept), docs[text_col].alias(text_name))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}`{out_col}` double, `{spans_col}` array<struct<start:int,end:int>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a toxicity score for every document; labels of the held-out fold aren't learnt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
