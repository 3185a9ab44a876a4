"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are laid out by a coarse signature (their strongest component, then id) in ranges, and cut into blocks. A block keeps the
forward index of its vectors (all their components) and, per component (a term), its largest and smallest value. A query's
bound for a block is the sum over its terms of the larger of query value times maximum or minimum. Each query visits its blocks by
falling bound, scores all vectors of a block, and stops when the next bound is below its k-th best score (equal ones
are still scored, for ties by id). Work is dealt by (block range, query chunk); each such task gives k rows a query,
and a last ranking merges them.

Components are floor(256 x), as long. Vectors that are null, empty, or hold a null or non-finite component take no part; those of
another length than the query's are no candidates of it. Ties go to smaller ids. Rows that repeat an id are candidates each;
rows with the query's own id are none of its candidates. A query with fewer than k candidates gets all. No rows give none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, table

#: Vectors in a block, in a range of blocks that one task holds at most and at least, and queries in a chunk.
BLOCK, RANGE, LEAST_RANGE, CHUNK = 64, 65_536, 4096, 8192


def scaled(vector: F.Column) -> F.Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: F.Column) -> F.Column:
    """Whether there are components, all finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: through doubles where these hold all sums, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if top < 2**53 else a @ b.T


def merge_best(score: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, row by row: higher scores first, then smaller ids; free places have id -1."""
    score, ids = np.concatenate((score, more), 1), np.concatenate((ids, more_ids), 1)
    free = ids == NONE
    order = np.lexsort((ids, -score, free), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


NONE, LOWEST = np.iinfo(np.int64).min, -(2**62)


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best vectors of each query, and how many pairs of a query and a block were scored."""
    at = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(vectors, at, 0).astype(float), np.minimum.reduceat(vectors, at, 0).astype(float)
    q = queries.astype(float)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, 1, kind="stable")
    score = np.full((len(q), k), LOWEST, np.int64)
    best = np.full((len(q), k), NONE, np.int64)
    live, done = np.arange(len(q)), 0
    for turn in range(len(at)):
        block = order[live, turn]
        # A block whose bound is below the k-th score can't matter, nor can any after it.
        stay = (best[live, -1] == NONE) | (bound[live, block] >= score[live, -1])
        live, block = live[stay], block[stay]
        if not len(live):
            break
        done += len(live)
        by = np.argsort(block, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
            own, b = live[group], int(block[group[0]])
            rows = slice(b * BLOCK, (b + 1) * BLOCK)
            s = product(queries[own], vectors[rows])
            own_ids = np.broadcast_to(ids[rows], s.shape)
            self_hit = own_ids == query_ids[own][:, None]
            score[own], best[own] = merge_best(score[own], best[own], np.where(self_hit, LOWEST, s), np.where(self_hit, NONE, own_ids), k)
    return score, best, done


def _searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in sorted(set(queries["v"].map(len)) if len(vectors) else ()):
            q, v = queries[queries["v"].map(len) == size], vectors[vectors["v"].map(len) == size]
            if not len(v):
                continue
            v = v.sort_values(["signature", "vec_id"])
            score, ids, _ = search_blocks(q["vec_id"].to_numpy(), np.stack(q["v"]), v["vec_id"].to_numpy(), np.stack(v["v"]), k)
            row, place = np.nonzero(ids != NONE)
            out.append(pd.DataFrame({"query_row": q["query_row"].to_numpy()[row], "query_id": q["vec_id"].to_numpy()[row], "vec_id": ids[row, place], "score": score[row, place]}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best rows of ``vectors`` for each row of ``queries``."""

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), scaled(v).alias("v"))

    base, asked = prepared(vectors), prepared(queries)
    n, m = base.count(), asked.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    ranges, chunks = max(1, -(-n // RANGE), min(cores, -(-n // LEAST_RANGE))), max(1, -(-m // CHUNK))
    strongest = F.array_max(F.transform("v", lambda x, i: F.struct(F.abs(x).alias("size"), i.alias("at"), (x > 0).alias("positive"))))
    signature = (strongest["at"] * 2 + strongest["positive"].cast("int")).alias("signature")
    # Ranges of (signature, id): like vectors share blocks, and any one signature's vectors spread over ranges by id.
    laid = checkpointed(base.withColumn("signature", signature).repartitionByRange(ranges, "signature", "vec_id").withColumn("range", F.spark_partition_id()))
    held = laid.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    several = laid.select("range").distinct()
    sent = checkpointed(asked.withColumn("query_row", F.monotonically_increasing_id()).withColumn("chunk", F.pmod(F.xxhash64("query_row"), F.lit(chunks)).cast("int")))
    every = sent.join(F.broadcast(several.agg(F.collect_list("range").alias("ranges")))).withColumn("range", F.explode("ranges")).drop("ranges")
    found = every.groupBy("range", "chunk").cogroup(held.groupBy("range", "chunk")).applyInPandas(_searcher(k), "query_row long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 5 best rows for every row whose id is divisible by 50, over all embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
