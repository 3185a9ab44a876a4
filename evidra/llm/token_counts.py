"""Token counts by offset-mapped attribution.

Each document is encoded once as a whole. The character spans of its tokens are then interval-joined to its sections, by
binary search within the document (spans and sections are both sorted, so no pairs are formed). Sections are the lines of
the text; blank lines belong to none. Rule for tokens that cross a boundary: a token goes whole to the section that holds
most of its bytes, the earlier one in a tie; tokens that touch no section (line breaks, blank lines) go to section -1.
So the counts of a document's sections add up to its token count.

Null and empty texts give one row: section -1 with no tokens. Repeated rows give repeated output; no rows, none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidra.llm.bpe import encoder, ranks_path
from evidra.llm.common import rows_in_chunks, runs, table


def attribute(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For sorted, disjoint sections [low, high): the section of each token span [begin, end), or -1."""
    if not len(low):
        return np.full(len(begin), -1)
    first = np.searchsorted(high, begin, "right")  # first section that ends behind the token's begin
    best, most = np.full(len(begin), -1), np.zeros(len(begin), np.int64)
    live = np.flatnonzero(first < len(low))
    at = first.copy()
    while len(live):
        k = at[live]
        shared = np.minimum(end[live], high[k]) - np.maximum(begin[live], low[k])
        better = shared > most[live]
        best[live[better]], most[live[better]] = k[better], shared[better]
        at[live] += 1
        live = live[(at[live] < len(low)) & (shared > 0)]
        live = live[low[at[live]] < end[live]]
    return best


def count_by_section(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and section: ``section`` (line number from 0; -1 outside), its code points from ``char_start`` to
    before ``char_end``, ``n_tokens`` given to it and how many of these cross its bounds. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for rows, texts in rows_in_chunks(batches, "_text"):
            _, text_at, begin, end = coder.encode(texts)
            out: list[list[np.ndarray]] = []
            byte_at = 0
            for i, text in enumerate(texts):
                raw = text.encode("utf-8", "replace")
                data = np.frombuffer(raw, np.uint8)
                low, high = runs(data != 10)
                line = np.cumsum(data == 10)[low] if len(low) else low
                dark = np.array([bool(raw[a:b].strip()) for a, b in zip(low.tolist(), high.tolist())], bool)
                low, high, line = low[dark], high[dark], line[dark]
                a, b = begin[text_at[i] : text_at[i + 1]] - byte_at, end[text_at[i] : text_at[i + 1]] - byte_at
                own = attribute(a, b, low, high)
                n = np.bincount(own + 1, minlength=len(low) + 1)
                cross = np.zeros(len(a), bool)
                cross[own >= 0] = (a[own >= 0] < low[own[own >= 0]]) | (b[own >= 0] > high[own[own >= 0]])
                crossing = np.bincount(own + 1, weights=cross, minlength=len(low) + 1).astype(np.int64)
                point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                keep = np.ones(len(n), bool)
                keep[0] = n[0] > 0 or not len(low)
                full = lambda outside, inside: np.concatenate(([outside], inside))[keep]
                out.append([np.full(int(keep.sum()), i), full(-1, line), full(0, point[low]), full(len(text), point[high]), n[keep], crossing[keep]])
                byte_at += len(raw)
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], [id_col, "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col].alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: tokens of each line of every document."""
    return count_by_section(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path())
