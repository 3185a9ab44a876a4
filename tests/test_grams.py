"""Stored postings against a plain search."""

import random

from pyspark.sql import functions as F

from evidra.functions.grams import contained, matches, read_index, write_index


def data(seed=4):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aab한국🙂 ") for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", None, "aaaaaaaa", "한국어 문서", "aaaaaaaa"]
    needles = [t[i : i + rng.randint(1, 9)] for t in rng.sample([t for t in texts if t], 60) for i in [rng.randrange(len(t))]] + ["zzz", "aaaaaaa", "", "한", "🙂 ", "aab한국🙂 aab한국🙂 "]
    return texts, needles


def test_contained(spark, tmp_path):
    texts, needles = data()
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, needle string").drop("needle")
    write_index(rows, "t", str(tmp_path / "ix"), splits=3, buckets=5)
    index = read_index(spark, str(tmp_path / "ix"))
    asked = spark.createDataFrame(list(enumerate(needles)), "k int, n string")
    got = sorted((r["k"], r["i"]) for r in contained(index, asked, "n").collect())
    assert got == sorted((k, i) for k, n in enumerate(needles) for i, t in enumerate(texts) if n and t and n in t)
    assert contained(index, asked.limit(0), "n").collect() == []


def test_found_from_postings_alone(spark, tmp_path):
    texts, needles = data()
    write_index(spark.createDataFrame([(t,) for t in texts], "t string"), "t", str(tmp_path / "ix"))
    index = read_index(spark, str(tmp_path / "ix"))
    found = matches(index, spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "positions" in plan and " t#" not in plan  # the texts' column isn't read
    hashes = {r["v"]: r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("v")).collect()}
    assert {(r["needle"], hashes[r["vid"]]) for r in found.collect()} == {(n, t) for n in needles for t in texts if n and t and n in t}


def test_a_frequent_gram_is_split(spark, tmp_path):
    texts = [f"aaaa{i}" for i in range(2000)]
    write_index(spark.createDataFrame([(t,) for t in texts], "t string"), "t", str(tmp_path / "ix"), splits=8, buckets=16)
    index = read_index(spark, str(tmp_path / "ix"))
    sizes = [r["count"] for r in index.postings.where("gram = 'aaa'").groupBy("split").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert matches(index, spark.createDataFrame([("aaaa",)], "n string"), "n").count() == 2000


def test_empty(spark, tmp_path):
    write_index(spark.createDataFrame([(None,)], "t string"), "t", str(tmp_path / "ix"))
    index = read_index(spark, str(tmp_path / "ix"))
    assert contained(index, spark.createDataFrame([("a",)], "n string"), "n").collect() == []
