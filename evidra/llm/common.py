"""Helpers shared by the corpus operators: table access, bounded text chunks, checkpoints and byte-level word hashes."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised step looks at; bounds a Python worker's memory whatever the batch holds.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, through Spark's reader only (the folder may be in any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where none is set, a folder of our own on one machine
    (``local`` masters, as in tests), and an error on a cluster: its executors share no temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, without their lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows as a table of its own below the checkpoint folder, and where it is; ``dropped`` deletes it once nothing reads it any more."""
    folder = f"{checkpoint_folder(df.sparkSession)}/rows-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def dropped(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Shares of rows from which a key counts as heavy: at most so many keys can hold more than one in so many of all rows.
HEAVY = 512


def join_uneven(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row a key and in ``count`` how many of the ``total`` rows have it. Keys that hold more
    than one in ``HEAVY`` of all rows, of which there can't be more than ``HEAVY``, are broadcast; the others meet in a shuffle where no
    key is large."""
    heavy = F.col(count) * HEAVY > total
    many = F.broadcast(side.where(heavy))
    few = rows.join(F.broadcast(side.where(heavy).select(*keys)), keys, "left_anti").join(side.where(~heavy), keys)
    return rows.join(many, keys).unionByName(few)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with so many underscores behind it that no column has this name (in any case of letters)."""
    names = {x.lower() for x in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def without(columns: list[str], names: list[str]) -> list[str]:
    """The columns that aren't called like one of ``names``."""
    return [c for c in columns if c.lower() not in {n.lower() for n in names}]


def text_chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` characters; a longer text makes a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def rows_in_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with about ``limit`` bytes of ``column``, and its values with null as empty. Only a slice at a time
    becomes Python strings; a longer text makes a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        until, start = np.cumsum(size), 0
        while start < len(size):
            before = until[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(until, before + limit, "right")))
            rows = batch.slice(start, end - start)
            yield rows, [t or "" for t in rows.column(column).to_pylist()]
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the low bytes of an eight-byte word: none to all eight.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices ``data[starts:ends]``: every eight bytes are mixed, then mixed again with their place in the slice,
    and summed. There is no polynomial whose algebra a repetitive text could meet."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = (ends - starts).astype(np.int64)
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))  # the eight bytes at each place
    blocks = np.maximum(1, (size + 7) >> 3)
    with np.errstate(over="ignore"):
        if int(blocks.max()) == 1:
            total = mix64(mix64((words[starts] & _LOW_BYTES[size]) + _STEP) + _STEP)
        else:
            first = np.cumsum(blocks) - blocks
            own = np.repeat(np.arange(len(size)), blocks)
            place = np.arange(len(own)) - first[own]
            each = (words[starts[own] + 8 * place] & _LOW_BYTES[np.minimum(size[own] - 8 * place, 8)]) + _STEP
            total = np.add.reduceat(mix64(mix64(each) + (place + 1).astype(np.uint64) * _STEP), first)
        return mix64(total + size.astype(np.uint64) * _STEP)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in UTF-8 bytes; other letters stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by one space, and the offset where each begins (plus the end)."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), at


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def spaced_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) texts: bytes, starts, ends, and per text its first word and the one after its last."""
    data, at = joined_bytes(texts)
    data = lower_ascii(data)
    starts, ends = runs(~((data == 32) | ((data >= 9) & (data <= 13))))
    first = np.searchsorted(starts, at)
    return data, starts, ends, first[:-1], first[1:]
