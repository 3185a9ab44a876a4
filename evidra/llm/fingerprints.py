"""Document fingerprints: a homomorphic multiset hash of a document's paragraphs.

A paragraph is a line of the text; a long one counts as consecutive units of ``UNIT_WORDS`` words from its beginning. Each
unit is hashed (BLAKE2b of its bytes, 512 bits) to a wide vector of ``LANES`` small signed numbers, and a document's fingerprint is
the sum of its units' vectors modulo 2^32. Sums don't depend on order, and adding or taking away a unit's vector inserts or deletes that unit
(``insert``, ``delete``). Equal texts have equal fingerprints; since the small numbers don't wrap in practice, the cosine
of two fingerprints read as signed numbers also estimates how alike the two multisets are (``likeness``, 0 to 1).

Null is an empty text, with the fingerprint of zeros; two empty texts are alike by 1, an empty and another by 0. Ties in the
order of documents are broken by text; repeated rows are documents of their own; a null id comes first. A single document
is followed by itself. Ids may be of any type that can be ordered. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import joined_bytes, rows_in_chunks, runs, table, text_chunks

LANES, UNIT_WORDS, CUT_SAMPLE = 64, 8, 50


def unit_vectors(raw: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``LANES`` numbers from -128 to 127 for each unit, the bytes from ``low`` to ``high``."""
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=LANES).digest() for a, b in zip(low.tolist(), high.tolist())]), np.int8).reshape(-1, LANES)


def units(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each unit begins and ends in them, and the text that it is in. Together, a text's units hold every byte but
    line ends."""
    data, at = joined_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    line_low, line_high = np.sort(np.concatenate((at[:-1], breaks + 1))), np.sort(np.concatenate((breaks, at[1:] - 1)))
    starts, ends = runs(~((data == 32) | ((data >= 9) & (data <= 13))))
    line = np.searchsorted(line_low, starts, "right") - 1
    count = np.arange(len(starts))
    new = np.ones(len(starts), bool)
    new[1:] = line[1:] != line[:-1]
    head = np.flatnonzero(new | ((count - np.maximum.accumulate(np.where(new, count, 0))) % UNIT_WORDS == 0))
    low = np.where(new[head], line_low[line[head]], ends[head - 1] if len(head) else 0)
    dark = np.setdiff1d(np.arange(len(line_low)), line)  # lines without words are units too, but for an empty text's
    dark = dark[~np.isin(line_low[dark], at[:-1][np.diff(at) == 1])]
    own = np.concatenate((line[head], dark))
    low = np.concatenate((low, line_low[dark]))
    order = np.argsort(low, kind="stable")
    own, low = own[order], low[order]
    high = line_high[own]
    same = np.flatnonzero(own[1:] == own[:-1])
    high[same] = low[same + 1]
    return data.tobytes(), low, high, np.searchsorted(at, low, "right") - 1


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of ``LANES`` sums (modulo 2^32) for each text."""
    out = np.zeros((len(texts), LANES), np.uint32)
    for a, b in text_chunks(texts):
        raw, low, high, text = units(texts[a:b])
        for k in range(0, len(low), 1 << 16):
            part = text[k : k + (1 << 16)]
            if len(part):
                head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                out[a + part[head]] += np.add.reduceat(unit_vectors(raw, low[k : k + (1 << 16)], high[k : k + (1 << 16)]).astype(np.int32), head, 0).astype(np.uint32)
    return out


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint of a document with one more paragraph."""
    return fingerprint + fingerprints([paragraph])[0]


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint of a document with that paragraph taken out."""
    return fingerprint - fingerprints([paragraph])[0]


def text_of(fingerprint: np.ndarray) -> str:
    """Hexadecimal, 8 digits a lane."""
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows as signed numbers, not below 0; 1 for equal rows."""
    x, y = a.view(np.int32).astype(float), b.view(np.int32).astype(float)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cos = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cos, 0, 1))


def _cuts(ids: DataFrame, n: int, kind: T.DataType) -> list:
    """Up to n - 1 values that cut ``ids`` (column _id) into ranges: quantiles of numbers; of other types, of the distinct ids whose hash
    falls into a share that makes some ``CUT_SAMPLE`` a range."""
    if isinstance(kind, T.NumericType):
        return sorted({c for c in (ids.agg(F.expr(f"approx_percentile(_id, array({', '.join(f'{k / n:.9f}D' for k in range(1, n))}), 100000)").alias("c")).first()["c"] or [])})
    share = max(1, ids.count() // (n * CUT_SAMPLE))
    some = [r[0] for r in ids.where(F.col("_id").isNotNull() & (F.pmod(F.xxhash64("_id"), F.lit(share)) == 0)).distinct().orderBy("_id").collect()]
    return sorted(set(some[len(some) // n :: max(1, len(some) // n)]))[: n - 1]


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents dealt by ranges of ``id_col`` in one shuffle, a range a partition, sorted within, where the row that follows a
    partition's last one is there too (``_extra``). Only bounds of ranges, a few ids a partition, reach the driver."""
    spark = docs.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col(id_col).alias("_id"))
    cuts = _cuts(ids, n, docs.schema[id_col].dataType)
    bucket = lambda c: sum((F.when(c > F.lit(x), 1).otherwise(0) for x in cuts), F.lit(0)) if len(cuts) < 2 else F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < c)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_bucket", bucket(F.col("_id")))
    found = ids.withColumn("_bucket", bucket(F.col("_id"))).groupBy("_bucket").agg(F.min("_id").alias("low"), F.count(F.when(F.col("_id").isNull(), 1)).alias("null")).orderBy("_bucket").collect()
    if not found:
        return rows.withColumn("_extra", F.lit(False))
    # The first row of each range goes to the range before as well; the first of all to the last.
    firsts = [(b["_bucket"], None if b["null"] else b["low"], found[i - 1]["_bucket"]) for i, b in enumerate(found)]
    kind = docs.schema[id_col].dataType
    heads = spark.createDataFrame(firsts, T.StructType([T.StructField("_bucket", T.IntegerType()), T.StructField("_id", kind), T.StructField("_to", T.IntegerType())]))
    same = rows.alias("r").join(F.broadcast(heads).alias("h"), (F.col("r._bucket") == F.col("h._bucket")) & F.col("r._id").eqNullSafe(F.col("h._id")))
    extra = same.groupBy("h._to").agg(F.min(F.struct("r._text", "r._id")).alias("first")).select(F.col("first._id").alias("_id"), F.col("first._text").alias("_text"), F.col("_to").alias("_bucket"), F.lit(True).alias("_extra"))
    return rows.withColumn("_extra", F.lit(False)).unionByName(extra).repartitionById(len(cuts) + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_extra", F.col("_id").asc_nulls_first(), "_text")


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by as many of the following text's first, or all of these."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike are these and the next document's."""
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(kind: pa.DataType, ids: list, texts: list[str], prints: np.ndarray) -> pa.RecordBatch:
        """All rows but the last, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        other = fingerprints(changed)
        own = prints[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], kind), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
                pa.array(map(text_of, own), pa.string()), pa.array(map(text_of, other), pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, prints[1:])),
            ],
            names,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, texts, prints = None, [], [], np.zeros((0, LANES), np.uint32)
        for batch in batches:
            for part, new_texts in rows_in_chunks([batch], "_text"):
                buckets = part.column("_bucket").to_pylist()
                new_ids, new_prints = part.column("_id").to_pylist(), fingerprints(new_texts)
                k = 0
                while k < len(buckets):
                    if buckets[k] != bucket:
                        bucket, ids, texts, prints = buckets[k], [], [], prints[:0]
                    end = k
                    while end < len(buckets) and buckets[end] == bucket:
                        end += 1
                    ids, texts, prints = ids + new_ids[k:end], texts + new_texts[k:end], np.concatenate((prints, new_prints[k:end]))
                    if len(ids) > 1:
                        yield result(batch.schema.field("_id").type, ids, texts, prints)
                    ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
                    k = end

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs, id_col, text_col).select("_id", "_text", "_bucket").mapInArrow(run, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
