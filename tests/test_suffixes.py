"""Longest common beginnings against brute force, over one range and over many."""

import os.path
import random

import pytest
from pyspark.sql import functions as F

from evidra.functions import ranges
from evidra.functions.suffixes import common_beginnings, common_length


@pytest.mark.parametrize("rows", [500_000, 20])
def test_common_beginnings(spark, monkeypatch, rows):
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
    rng = random.Random(rows)
    text = lambda: "".join(rng.choice("ab가") for _ in range(rng.randint(1, 9)))
    texts, words = sorted({text() for _ in range(120)}), sorted({text() for _ in range(150)})
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {r["w"]: r["n"] for r in common_beginnings(frame(words, "w"), "w", frame(texts, "t"), "t").collect()}
    assert got == {w: max(len(os.path.commonprefix([w, t])) for t in texts) for w in words}
    assert {r["n"] for r in common_beginnings(frame(words, "w"), "w", frame(texts, "t").limit(0), "t").collect()} == {0}


def test_common_length(spark):
    pairs = [("", "a"), ("a", "a"), ("abc", "abd"), ("가나다", "가나"), ("x", "y"), ("a" * 1000 + "b", "a" * 1000 + "c")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r["n"] for r in df.select("i", common_length(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()] == [len(os.path.commonprefix(list(p))) for p in pairs]
