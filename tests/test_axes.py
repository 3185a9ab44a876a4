"""Time axes over several ranges of days against brute force, and the guards on what may be summed."""

import random
from datetime import date, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evidra.functions import ranges
from evidra.operators import axes as X

DAY = date(2024, 1, 1)
SCHEMA = "table_id string, path string, signature int, kind string, start date, end date, months int, base_date date, data_date date, stock boolean"


def tables(n, seed, signatures=3):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(["dates", "dates", "dates", "months", None])
        a = DAY + timedelta(rng.randint(0, 900))
        months = sum(1 << m for m in rng.sample(range(1, 13), rng.randint(1, 2)))
        day = None if rng.random() < 0.1 else DAY + timedelta(rng.randint(0, 20))
        out.append((f"t{i}", f"f{rng.randint(0, n // 3)}", rng.randint(1, signatures), kind, *((a, a + timedelta(rng.randint(0, 9))) if kind == "dates" else (None, None)), months if kind == "months" else None, day, day, rng.random() < 0.2))
    return out


def overlap(a, b):
    return a[3] == b[3] and ((a[3] == "dates" and a[4] <= b[5] and b[4] <= a[5]) or (a[3] == "months" and a[6] & b[6] != 0))


@pytest.fixture(params=[500_000, 20])
def few_rows_a_range(request, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", request.param)


def test_overlap_groups(spark, few_rows_a_range):
    rows = tables(150, 1)
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(rows, 2):
        if a[2] == b[2] and overlap(a, b):
            up[root(a[0])] = root(b[0])
    got = X.overlap_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    groups = {}
    for r in got:
        if r["time_group"]:
            groups.setdefault((r["signature"], r["time_group"]), set()).add(r["table_id"])
    want = {}
    for r in rows:
        if r[3]:
            want.setdefault(root(r[0]), set()).add(r[0])
    assert len(got) == len(rows) and sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(r["group_size"] == len(groups[r["signature"], r["time_group"]]) for r in got if r["time_group"])


def test_same_layout(spark, few_rows_a_range):
    rows = tables(120, 2, 2)
    want = set()
    for a in rows:
        able = [b for b in rows if a is not b and a[2] == b[2] and (a[1] == b[1] or (a[3] and b[3] and not overlap(a, b)))]
        able.sort(key=lambda b: (a[1] != b[1], b[8] is None, -b[8].toordinal() if b[8] else 0, b[0]))
        want |= {(a[0], b[0]) for b in able[:5]}
    got = X.same_layout(spark.createDataFrame(rows, SCHEMA), 5)
    assert {tuple(r) for r in got.collect()} == want


def test_guard(spark):
    rows = tables(400, 3, 130)
    want = {}
    for a in rows:
        others = [b for b in rows if b is not a and b[2] == a[2]]
        blind = [b for b in others if b[1] != a[1] and not (a[3] and b[3])]
        stock = any(b[9] for b in [a, *others])
        want[a[0]] = "overlap" if any(overlap(a, b) for b in others) else "stock" if blind and stock else "same_base_date" if any(b[7] and b[7] == a[7] for b in blind) else "ok"
    got = {r["table_id"]: r["verdict"] for r in X.double_count_guard(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert set(want.values()) == {"overlap", "stock", "same_base_date", "ok"}


def test_excerpts_of_the_same_months_are_refused_and_other_months_are_not(spark):
    rows = [("a", "team.xlsx", "7월", None), ("a", "team.xlsx", "8월", None), ("b", "monthly.xlsx", "8월", None), ("c", "later.xlsx", "9월", None), ("d", "odd.xlsx", "total", None), ("e", "ledger.xlsx", "9월", DAY)]
    df = spark.createDataFrame(rows, "table_id string, path string, m string, day date")
    axes = X.time_axis(df, ["table_id", "path"], F.col("day"), F.col("m"))
    assert {r["table_id"]: (r["kind"], r["months"]) for r in axes.collect()} == {"a": ("months", 1 << 7 | 1 << 8), "b": ("months", 1 << 8), "c": ("months", 1 << 9), "d": (None, None), "e": ("dates", None)}
    full = axes.where("kind is not null").withColumns({"signature": F.lit(1), "base_date": F.lit(None).cast("date"), "stock": F.lit(True)})
    assert {r["table_id"]: r["verdict"] for r in X.double_count_guard(full).collect()} == {"a": "overlap", "b": "overlap", "c": "ok", "e": "ok"}
    assert X.double_count_guard(full.limit(0)).collect() == []


def test_axes_overlap(spark):
    day = lambda d: F.lit(d).cast("date")
    axis = lambda kind, a, b, m: F.struct(F.lit(kind).alias("kind"), day(a).alias("start"), day(b).alias("end"), F.lit(m).cast("int").alias("months"))
    one, two, seven, both, none = axis("dates", "2024-01-01", "2024-01-31", None), axis("dates", "2024-01-31", "2024-02-01", None), axis("months", None, None, 128), axis("months", None, None, 384), axis(None, None, None, None)
    pairs = [(one, two, True), (seven, both, True), (seven, axis("months", None, None, 2), False), (one, seven, False), (one, none, False), (none, none, False)]
    row = spark.range(1).select(*(X.axes_overlap(a, b).alias(str(i)) for i, (a, b, _) in enumerate(pairs))).first()
    assert list(row) == [w for *_, w in pairs]
