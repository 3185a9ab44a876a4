"""Whitening of embeddings with the covariance weighted by multiplicity.

Equal vectors are grouped first: each distinct vector x (integers: scaled, floored, shifted) is kept once with its count. Counts, or ones,
are the weights of the fit. Sums are exact integers; the covariance is a weighted product of matrices of centred vectors in each task, of
which only one matrix a task is shuffled and one in all reaches the driver (dimensions squared, whatever the rows). Its unit
eigenvectors, largest first, give the components; each distinct vector is whitened once, and rows get theirs back by a join.

Cases. Vectors that are null, empty or hold null or non-finite entries take no part and give no rows. Vectors of another length than
most (ties: the longer) take no part either. Entries beyond ``MOST`` in size after scaling count as ``MOST``. Components without
variance (constant or dependent dimensions, too few rows) have null instead of whitened values and 0 as their share. Repeated rows,
null ids and further columns stay as they are; columns called like the results give way to them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, join_uneven, table, without

#: Largest size of a scaled entry; whole numbers up to there and their differences fit into 64 bits.
MOST = 2**61
#: Eigenvalues below this share of the largest one, for each dimension, are noise of the arithmetic.
NOISE = 1e-14
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
WHOLE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Fit:
    """``n`` vectors were fitted (weights summed) with per-dimension sums ``sums``; ``vectors`` holds one unit component a column."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def known(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > NOISE * len(self.sums) * max(self.trace, 0.0)

    def axes(self, k: int) -> np.ndarray:
        """The first ``k`` components, each divided by its standard deviation; NaN without variance."""
        e = np.where(self.known, self.values, np.nan)[:k]
        return self.vectors[:, :k] / np.sqrt(e)

    def explained(self, k: int) -> list[float]:
        return [float(e / self.trace) if known else 0.0 for e, known in zip(self.values[:k], self.known)]


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def whole(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * scale))).cast("long") + shift)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches, their vectors ``x`` as a matrix, and weights ``w``."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("w").to_numpy(zero_copy_only=False)


def _safe(x: np.ndarray, w: np.ndarray | float) -> np.ndarray:
    """Numbers as 64-bit integers where products with ``w``, summed, fit; as unbounded ones else."""
    bound = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.max(w, initial=1)) * x.size
    return x if bound < 2**62 else x.astype(object)


def column_sums(vectors: DataFrame) -> list[int]:
    """Exact weighted sums by dimension of ``vectors`` (x, w): one row a task and dimension is shuffled, one a dimension is collected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for _, x, w in _blocks(batches):
            part = [int(v) for v in (_safe(x, w) * w[:, None]).sum(0)]
            total = [a + b for a, b in zip(total, part)] if total else part
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), WHOLE)], ["i", "s"])

    found = vectors.select("x", "w").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return [int(r["s"]) for r in found]


def _middle(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the (small) rest, so that centring loses no digits to the vectors' common size."""
    whole_part = [round(Fraction(s, n)) for s in sums]
    return np.array(whole_part, np.int64), np.array([float(Fraction(s, n) - c) for s, c in zip(sums, whole_part)])


def covariance(rows: DataFrame, n: int, centred: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], d: int) -> np.ndarray:
    """Weighted covariance (divisor ``n``) of what ``centred`` makes of each batch (matrix, weights): products of matrices in the tasks, then
    sums by place."""
    low, high = np.triu_indices(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y, w = centred(batch)
                total += (y * w[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(total[low, high])], ["i", "j", "v"])

    found = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v / n
    return out


def fit(vectors: DataFrame, d: int) -> Fit:
    """Fit on distinct vectors (x of ``d`` longs, w)."""
    n = int(vectors.agg(F.sum("w")).first()[0])
    sums = column_sums(vectors)
    middle, rest = _middle(n, sums)

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        _, x, w = next(_blocks([batch]))
        return (x - middle).astype(np.float64) - rest, w.astype(np.float64)

    v = covariance(vectors.select("x", "w"), n, centred, d)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    signs = np.where(axes[np.abs(axes).argmax(0), np.arange(d)] < 0, -1.0, 1.0)  # the largest entry is positive
    return Fit(n, sums, values, axes * signs, float(np.trace(v)))


def whiten_distinct(vectors: DataFrame, model: Fit, k: int) -> DataFrame:
    """Distinct vectors (key1, key2, x, w, rows) with ``whitened`` (an array of ``k``) and the exact ``deviation``, without x."""
    middle, rest = _middle(model.n, model.sums)
    axes, n = model.axes(k), model.n
    gone = [s - n * int(c) for s, c in zip(model.sums, middle)]  # n * x - S = n * (x - middle) - gone

    def deviations(y: np.ndarray) -> pa.Array:
        size = (float(n) * float(np.abs(y.astype(np.float64)).max(initial=0)) + float(max(map(abs, gone)))) ** 2 * y.shape[1]
        if size < 2**62:
            return pa.array(((n * y - np.array(gone, np.int64)) ** 2).sum(1)).cast(WHOLE)
        exact = ((n * y.astype(object) - np.array(gone, object)) ** 2).sum(1)
        return pa.array([Decimal(int(v)) if int(v) < 10**38 else None for v in exact], WHOLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, _ in _blocks(batches):
            y = x - middle
            z = (y.astype(np.float64) - rest) @ axes
            flat = pa.array(z.ravel(), from_pandas=True)  # NaN is null
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key1", "key2", "w", "rows")), pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), flat), deviations(y)], ["key1", "key2", "w", "rows", "whitened", "deviation"])

    return vectors.mapInArrow(run, "key1 long, key2 long, w long, rows long, whitened array<double>, deviation decimal(38,0)")


def identity_error(whitened: DataFrame, model: Fit, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    places = np.flatnonzero(model.known[:k])
    if not len(places):
        return 0.0
    means = whitened.select(*(F.sum(F.col("whitened")[int(i)] * F.col("w")) / model.n for i in places)).first()
    middle = np.array(means, np.float64)

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = pc.fill_null(batch.column("whitened").flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, places]
        return z - middle, batch.column("w").to_numpy(zero_copy_only=False).astype(np.float64)

    return float(np.abs(covariance(whitened.select("whitened", "w"), model.n, centred, len(places)) - np.eye(len(places))).max())


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "count", scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Fit | None, float]:
    """(rows, fit, identity error): all columns of ``df`` for rows with usable vectors, and ``whitened`` (array, one number a component) and
    ``deviation`` (exact squared distance of n*x from the sums). ``weights``: ``count`` fits on all rows, ``one`` on each distinct vector once."""
    if weights not in ("count", "one"):
        raise ValueError("weights: count or one")
    kept = without(df.columns, ["whitened", "deviation"])
    plain = df.select(F.struct(*(df[c] for c in kept)).alias("row"), df[vector_col].cast("array<double>").alias("c")) if kept else df.select(F.lit(None).alias("row"), df[vector_col].cast("array<double>").alias("c"))
    x = plain.where(usable(F.col("c"))).select("row", whole(F.col("c"), scale, shift).alias("x"))
    keyed = x.select("row", "x", F.xxhash64("x").alias("key1"), F.xxhash64(F.lit(7), "x").alias("key2"))  # 128 bits from two seeds
    counted = keyed.groupBy("x", "key1", "key2").agg(F.count("*").alias("rows"))
    distinct = checkpointed(counted.withColumn("w", F.col("rows") if weights == "count" else F.lit(1).cast("long")))
    usual = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return keyed.select("row.*", F.array().cast("array<double>").alias("whitened"), F.lit(None).cast("decimal(38,0)").alias("deviation")), None, 0.0
    fitted = distinct.where(F.size("x") == usual["d"])
    model = fit(fitted, usual["d"])
    k = min(components, usual["d"])
    white = checkpointed(whiten_distinct(fitted, model, k))
    joined = join_uneven(keyed.select("row", "key1", "key2"), white.drop("w"), ["key1", "key2"], "rows", usual["n"])
    return joined.select("row.*", "whitened", "deviation"), model, identity_error(white, model, k)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: up to 8 whitened components of every embedding."""
    rows, model, error = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = model.explained(COMPONENTS) if model else []
    each = rows.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"))
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1) if shares else F.lit(None).cast("double")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
