"""Mixes against a plain computation: targets by repeated sharing, slots by exact golden-ratio points."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evidra.llm import mixing as mx
from tests.conftest import DATA
from tests.oracle import common, connection


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shared(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Targets of sources in order, by literally sharing the excess anew."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while True:
        total = sum(w[i] for i in open_)
        for i in open_:
            target[i] = left * w[i] / total
        over = {i for i in open_ if target[i] > most * sizes[i]}
        if not over:
            return target
        for i in over:
            target[i] = Fraction(most * sizes[i])
            left -= target[i]
        open_ -= over


def rows_of(n, names):
    out, text = [], lambda i: " ".join(f"w{i}_{k}" for k in range(i * i % 37 if i % 50 else 3000))
    for i in range(n):
        out.append((i, text(i) if i % 11 else None, names[i % len(names)] if i % 3 else names[0]))
    return out


def test_points(spark):
    step, ids = mx.STEP, [0, 1, 2, 12345, 2**39 + 77, 2**40 - 1, 2**40 + 5, 2**55 + 3]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mx.point(F.col("i")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: i * step % 2**40 for i in ids}


@pytest.mark.parametrize("names,block", [(["a", "Z", "é", None, "", "b"], 16), (["only"], 7), (["x", "y"], 256)])
def test_mix(spark, names, block):
    rows = rows_of(400, names) + rows_of(3, names)
    docs = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, source string, size string, slot int").repartition(5)
    mixed = mx.mix(docs, block=block)
    out = mixed.collect()
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    want = dict(zip(order, shared([size[s] for s in order])))
    digest = lambda i, t: hashlib.md5(f"{i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    stream = {s: [w for _, i, t in sorted((digest(i, t), i, t or "") for i, t, x in rows if x == s) for w in words(t)] for s in order}
    text = {digest(i, t): words(t) for i, t, _ in rows}
    slots, whose = defaultdict(list), {}
    for r in out:
        assert r["target"] == pytest.approx(float(want[r["source"]])) and r["source_size"] == size[r["source"]] and r["size"] == len(text[r["digest"]])
        if r["slot"] is not None:
            assert whose.setdefault(r["slot"], r["source"]) == r["source"]
            slots[r["slot"]].append((r["pass"], r["ordinal"], text[r["digest"]][r["from_word"] : r["to_word"]]))
    # Slots read in order give each source's shuffled stream, pass after pass, up to its target.
    read = {s: [] for s in order}
    for k in sorted(slots):
        piece = [w for *_, p in sorted(slots[k], key=lambda x: x[:2]) for w in p]
        assert len(piece) <= block
        read[whose[k]] += piece
    for s in order:
        quota = int(want[s])
        assert read[s] == (stream[s] * 2)[:quota]
    # Slots go to the source whose stretch of cumulated quotas holds the point.
    total, n = sum(int(want[s]) for s in order), -(-sum(int(want[s]) for s in order) // block)
    edges, so_far = [], 0
    for s in order:
        edges.append(((so_far << 40) // total, ((so_far + int(want[s])) << 40) // total, s))
        so_far += int(want[s])
    for k, s in whose.items():
        if k < n:
            assert next(x for lo, hi, x in edges if lo <= k * mx.STEP % 2**40 < hi) == s
    assert sum(k >= n for k in whose) <= 4 * len(order)
    for m in (n // 4, n // 2, n):  # every beginning of the mix has the weights, to a few slots
        for s in order:
            assert abs(sum(whose.get(k) == s for k in range(m)) - m * want[s] / sum(want.values())) <= 5
    got = {(r["slot"], r["place"]): (r["source"], r["text"]) for r in mx.mixed_texts(docs, mixed).collect()}
    for k in slots:
        pieces = [" ".join(p) for *_, p in sorted(slots[k], key=lambda x: x[:2])]
        assert [got[k, i + 1] for i in range(len(pieces))] == [(whose[k], p) for p in pieces]


def test_query(spark):
    rows = mx.op11_source_mix(spark, DATA).toPandas()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert ((rows["taken"] >= 0) & (rows["taken"] <= 2 * rows["size"])).all()
    assert common(rows) == common(connection(DATA).execute(mx.SQL).df())


def test_odd(spark, odd, none):
    rows = odd.withColumn("source", F.lit(None).cast("string"))
    got = mx.mix(rows)
    assert got.select("digest", "ordinal").distinct().count() == odd.count()
    assert mx.mix(none.withColumn("source", F.lit("a"))).collect() == []
    blank = rows.where("text is null or trim(text) = ''")
    assert {(r["slot"], r["target"], r["size"]) for r in mx.mix(blank).where("size = 0").collect()} == {(None, 0.0, 0)}
