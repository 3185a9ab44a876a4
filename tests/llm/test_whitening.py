"""Whitening against a plain computation with exact sums."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import whitening as wh
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, whitened string, Deviation int, key1 long, x string"


def plain(vectors, k=8):
    """n, exact sums, exact deviations, whitened values and eigenvalues of whole vectors."""
    n, d = len(vectors), len(vectors[0])
    sums = [sum(v[i] for v in vectors) for i in range(d)]
    deviations = [sum((n * v[i] - sums[i]) ** 2 for i in range(d)) for v in vectors]
    y = np.array([[float(Fraction(n * v[i] - sums[i], n)) for i in range(d)] for v in vectors])
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return deviations, y @ axes / np.sqrt(e), e


def whole(v):
    return [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]


def check(got, vectors, weights="count"):
    fitted = vectors if weights == "count" else {tuple(v): v for v in vectors.values()}
    keys = list(fitted)
    deviations, white, e = plain([fitted[i] for i in keys])
    where = {tuple(fitted[i]): k for k, i in enumerate(keys)}
    signs = None
    for i, v in vectors.items():
        k = where[tuple(v)]
        assert int(got[i]["deviation"]) == deviations[k]
        mine = np.array(got[i]["whitened"])
        signs = np.sign(mine * white[k]) if signs is None else signs
        assert np.allclose(mine * signs, white[k], atol=1e-8)
    return e


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 10)) * np.arange(1, 11)
    rows = [(i, [float(c) for c in base[i % 60 if i < 90 else 0]]) for i in range(150)]  # one vector 62 times
    df = spark.createDataFrame([(*r, "w", 1, 2, "x") for r in rows], SCHEMA).repartition(7)
    out, model, error = wh.whiten(df, weights=weights)
    assert out.columns == ["vec_id", "embedding", "key1", "x", "whitened", "deviation"]
    got = {r["vec_id"]: r for r in out.collect()}
    e = check(got, {i: whole(v) for i, v in rows}, weights)
    assert np.allclose(model.values[:8], e) and error < 1e-9 and len(got) == 150
    assert model.n == (150 if weights == "count" else 60)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 5.0]), (4, [1e30, -1e30]), (4, [3.0, 4.0])]
    bad = [(5, None), (6, []), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0])]
    out, model, error = wh.whiten(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>"))
    rows = out.collect()
    assert sorted(str(r["vec_id"]) for r in rows) == ["1", "1", "4", "4", "None"] and model.n == 5
    assert all(r["deviation"] is None or r["deviation"] >= 0 for r in rows)  # null beyond 38 digits


def test_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<float>")
    out, model, error = wh.whiten(same)
    for r in out.collect():
        assert r["whitened"][0] == pytest.approx(1 if r["vec_id"] % 2 else -1) or r["whitened"][0] == pytest.approx(-1 if r["vec_id"] % 2 else 1)
        assert r["whitened"][1:] == [None, None]
    assert model.explained(8)[1:] == [0.0, 0.0] and error < 1e-9
    assert [r["whitened"] for r in wh.whiten(same.limit(1))[0].collect()] == [[None, None, None]]
    empty, model, _ = wh.whiten(same.limit(0))
    assert empty.collect() == [] and model is None


def test_query(spark):
    rows = wh.op13_embedding_whitening(spark, DATA).collect()
    given = {r["vec_id"]: whole(r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {"deviation": r["deviation"], "whitened": {}})["whitened"][r["component"]] = r["whitened"]
    got = {i: {**v, "whitened": [v["whitened"][c] for c in sorted(v["whitened"])]} for i, v in got.items()}
    e = check(got, given)
    _, _, values = plain(list(given.values()), 64)
    assert {r["component"]: r["explained"] for r in rows} == pytest.approx({c + 1: e[c] / values.sum() for c in range(8)}, rel=1e-9)
    assert {r["n"] for r in rows} == {len(given)} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-6
    assert len(rows) == 8 * len(given)


def test_uneven_join(spark):
    from evidra.llm.common import join_uneven

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert join_uneven(rows, side, ["k"], "n", 3000).agg(F.count("*"), F.sum("n")).first()[:] == (3000, 2000 * 2000 + 1000)
