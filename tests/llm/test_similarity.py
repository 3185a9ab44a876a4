"""Near duplicates, fingerprints and top-k search against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.llm import fingerprints as fp
from evidra.llm import near_duplicates as nd
from evidra.llm import topk
from tests.conftest import DATA
from tests.llm.conftest import TEXTS, WORDS
from tests.oracle import common, connection


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(docs, n, percent):
    sets, up = {i: shingles(t, n) for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    random.seed(9)
    text = lambda n: [random.choice(WORDS) + str(random.randint(0, 40)) for _ in range(n)]
    passage, docs = text(40), []
    for g in range(25):
        base = text(random.choice([2, 3, 5, 9, 12, 30, 80, 200]))
        for _ in range(random.randint(1, 8)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                copy[random.randrange(len(copy))] = "new" + str(random.randint(0, 999))
            docs.append(" ".join(copy + (passage if g % 3 == 0 else [])))
    docs += ["", "  ", docs[0], docs[0].upper()]
    return list(enumerate(docs))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_near_duplicates(spark, n, percent):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, n, percent).collect()}
    assert got == brute(docs, n, percent)


def test_small_chunks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK_SHINGLES", 400)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, 5, 80).collect()}
    assert got == brute(docs, 5, 80)


class Groups:
    def __init__(self, ties=()):
        self.up = {}
        for a, b in ties:
            a, b = self.root(a), self.root(b)
            self.up[max(a, b)] = min(a, b)

    def root(self, i):
        while self.up.get(i, i) != i:
            i = self.up[i]
        return i


@pytest.mark.parametrize("pairs", [64, 2])
def test_ties_keep_links_together(monkeypatch, pairs):
    monkeypatch.setattr(nd, "ALL_PAIRS", pairs)
    docs = [(i, t) for i, t in corpus() if len(t.split()) >= 5]
    sets = sorted(((i, s) for (i, _), s in zip(docs, nd.shingle_sets([t for _, t in docs], 5))), key=lambda x: (len(x[1]), x[0]))
    ids, sizes = np.array([i for i, _ in sets]), np.array([len(s) for _, s in sets])
    groups = Groups(nd.tie_group(ids, sizes, nd.sketches([s for _, s in sets]), np.zeros(len(ids), np.int64), 80))
    for i, (_, group) in brute(docs, 5, 80).items():
        assert groups.root(i) == groups.root(group)


@pytest.mark.parametrize("pairs,rows", [(3, 5), (3, 30), (40, 45), (64, 70)])
def test_ties_of_a_large_part_go_on_over_batches(monkeypatch, pairs, rows):
    monkeypatch.setattr(nd, "ALL_PAIRS", pairs)
    draw = np.random.default_rng(rows)
    sets = [np.unique(draw.integers(0, 2**63, 100, dtype=np.uint64)) for _ in range(300)]
    sets += [np.append(s[:97], draw.integers(0, 2**63, 3, dtype=np.uint64)) for s in sets]  # linked to those 300 rows before
    sets += [np.unique(draw.integers(0, 2**63, 100, dtype=np.uint64)) for _ in range(4)]
    sets += [sets[-1], sets[-2]]
    part = [7] * 600 + [8] * 6  # the second part is small: only its equal sets are near
    n = len(sets)
    table = pa.table({"part": pa.array(part, pa.int64()), "node": pa.array(range(n), pa.int64()), "size": pa.array([len(s) for s in sets], pa.int32()), "reach": pa.array([0] * n, pa.int16()), "sketch": pa.array([c.tobytes() for c in nd.sketches(sets)], pa.binary())})
    groups = Groups(t for batch in nd._tied(80)(table.to_batches(max_chunksize=rows)) for t in zip(*(c.to_pylist() for c in batch.columns)))
    assert all(groups.root(i) == groups.root(i + 300) for i in range(300))
    assert len({groups.root(i) for i in range(300)}) > 250 and len({groups.root(i) for i in range(n - 6, n)}) == 4 and groups.root(n - 6) != groups.root(0)


@pytest.mark.parametrize("percent,combined", [(80, 300), (80, 20_000), (90, 5000)])
def test_followers_lose_no_link(monkeypatch, percent, combined):
    """Tasks drop followers, groups keep leaders: what is linked stays tied, and most rows of large groups don't travel."""
    monkeypatch.setattr(nd, "COMBINED", combined)
    monkeypatch.setattr(nd, "ALL_PAIRS", 4)
    random.seed(percent)
    bases = [[random.choice(WORDS) + str(random.randint(0, 60)) for _ in range(n)] for n in (12, 60, 90, 150)]
    docs = []
    for i in range(240):  # chains of edits, and words put in or left out, so that sizes differ
        words = bases[i % 4]
        k = random.randrange(len(words))
        words[k : k + random.randint(0, 2)] = [f"new{random.randint(0, 999)}" for _ in range(random.randint(0, 2))]
        docs.append((i, " ".join(words)))
    sets = nd.shingle_sets([t for _, t in docs], 5)
    by_node = {nd.set_digest(s)[0]: s for s in sets}
    rows = []
    for k in range(0, 240, 60):  # four tasks
        batch = pa.RecordBatch.from_pydict({"_id": [i for i, _ in docs[k : k + 60]], "_text": [t for _, t in docs[k : k + 60]]})
        rows += [r for b in nd._keyed(5, percent)(batch.slice(a, 7) for a in range(0, 60, 7)) for r in zip(*(c.to_pylist() for c in b.columns))]
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    codes = dict(zip(by_node, nd.sketches(list(by_node.values()))))
    table = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int16()), pa.array([codes[r[1]].tobytes() for r in rows], pa.binary())], ["part", "node", "size", "reach", "sketch"])
    groups = Groups(t for b in nd._tied(percent)(table.to_batches(max_chunksize=37)) for t in zip(*(c.to_pylist() for c in b.columns)))
    nodes, links = list(by_node), 0
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            x, y = by_node[a], by_node[b]
            if nd.linked(len(np.intersect1d(x, y)), len(x), len(y), percent):
                links += 1
                assert groups.root(a) == groups.root(b)
    assert links > 50 and len(rows) < 0.9 * sum(len(nd.part_keys(s, percent)) for s in by_node.values())


def test_repetitive_texts_differ():
    """Strings that collide under any polynomial modulo 2^64."""
    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    one, two = ("".join(pair[b] for b in bits) for pair in ("ab", "ba"))
    assert (fp.fingerprints([one])[0] != fp.fingerprints([two])[0]).any()
    assert nd.shingle_sets([one], 3)[0].tolist() != nd.shingle_sets([two], 3)[0].tolist()


def test_linked_sets_share_a_part():
    random.seed(2)
    for _ in range(300):
        percent = random.choice([80, 90])
        a = np.array(random.sample(range(1 << 60), random.randint(1, 300)), np.uint64)
        b = a.copy()
        while True:  # as many changes as a link allows
            c = b.copy()
            c[random.randrange(len(c))] = random.randrange(1 << 60)
            if not nd.linked(len(np.intersect1d(a, c)), len(a), len(c), percent):
                break
            b = c
        assert set(nd.part_keys(np.unique(a), percent)) & set(nd.part_keys(np.unique(b), percent))
        x, y = nd.sketches([np.unique(a), np.unique(b)])
        assert nd.differing(x, y) <= nd.FAR * max(nd.filled(x), nd.filled(y))


def test_several_texts_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "x"), (1, "quite another text with its own words", "y"), (2, text + " more", "x"), (3, "quite another text with its own words", "x"), (3, None, "z")], "doc_id long, text string, node string")
    got = {tuple(r) for r in nd.near_duplicates(docs, 3, 80, keep=("node",)).select("doc_id", "node", "component_id").collect()}
    assert got == {(1, "x", 1), (2, "x", 1), (1, "y", 1), (3, "x", 1), (3, "z", 3)}


def test_odd_documents(odd, none):
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and not nd.near_duplicates(none).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[6]["component_id"] == 5 and got[1]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[None]["component_id"] is None


def test_fingerprints(spark, odd, none):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in fp.fingerprint_documents(docs).collect()}
    texts = [t or "" for t in TEXTS]
    assert len(rows) == len(texts) and not fp.fingerprint_documents(none).collect()
    assert len(fp.fingerprint_documents(odd).collect()) == odd.count()
    for i, text in enumerate(texts):
        changed = fp.edited(text, texts[(i + 1) % len(texts)])
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i]["fingerprint"] == fp.text_of(fp.fingerprints([text])[0]) and rows[i]["edited_fingerprint"] == fp.text_of(fp.fingerprints([changed])[0])
    assert rows[5]["near_next"] == 1.0 and rows[5]["fingerprint"] == rows[6]["fingerprint"]


def test_ids_of_other_types(spark, odd):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: r for r in fp.fingerprint_documents(docs).collect()}
    named = fp.fingerprint_documents(docs.withColumn("doc_id", F.format_string("d%03d", "doc_id"))).collect()
    assert len(named) == len(want) and all(tuple(r)[1:] == tuple(want[int(r["doc_id"][1:])])[1:] for r in named)
    days = docs.withColumn("doc_id", F.expr("date'2024-01-01' + cast(doc_id as int)")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("date")))
    assert fp.fingerprint_documents(days).count() == len(want) + 1


def test_multiset_hash():
    a, b, c, whole = fp.fingerprints(["one two\nthree", "three\none two", "three", "one two\nthree\n"])
    assert (a == b).all() and (fp.insert(c, "one two") == a).all() and (fp.delete(a, "one two") == c).all() and (a != whole).any()
    random.seed(5)
    lines = ["".join(random.choices("abcdef ", k=50)) for _ in range(80)]
    x, y, z = fp.fingerprints(["\n".join(lines), "\n".join(lines[:60] + lines[:0] + ["q" + s for s in lines[60:]]), "\n".join(s[::-1] for s in lines)])
    near, far = fp.likeness(x[None], y[None])[0], fp.likeness(x[None], z[None])[0]
    assert 0.5 < near < 0.95 and far < 0.4


def test_top_k_against_sql(spark):
    got = topk.op1_top_k(spark, DATA).toPandas()
    assert common(got) == common(connection(DATA).execute(topk.SQL).df())


def test_top_k_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    random.seed(7)
    rows = [(i, [float(random.randint(-2, 2)) for _ in range(3)], "x", 1) for i in range(60)]
    rows += [(100, None, "", 1), (101, [1.0, None, 2.0], "", 1), (102, [float("nan"), 1.0, 1.0], "", 1), (103, [], "", 1), (104, [1.0, 1.0], "", 1), (7, [1.0, 1.0, 1.0], "", 1), (None, [1.0, 1.0, 1.0], "", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int")
    queries = df.where("vec_id % 10 = 0 or vec_id = 104")
    assert not topk.top_k(df.limit(0), df.limit(0)).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, queries, 5).collect()}
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 3]
    want = {}
    for q, v in [x for x in good if x[0] % 10 == 0]:
        best = sorted(((-int(np.dot(v, w)), i) for i, w in good if i != q))[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_blocks_are_pruned_on_sparse_vectors():
    random.seed(1)
    vectors = np.zeros((1024, 64), np.int64)
    for i in range(1024):  # topics: few terms each, like documents
        vectors[i, (i // 64 * 4) : (i // 64 * 4) + 4] = [random.randint(100, 200) for _ in range(4)]
    ids = np.arange(1024)
    score, best, done = topk.search_blocks(ids[:100], vectors[:100], ids, vectors, 5)
    exact = vectors[:100] @ vectors.T
    exact[np.arange(100), np.arange(100)] = -1
    assert (np.sort(exact, 1)[:, :-6:-1] == score).all() and done < 100 * 16 / 4


@pytest.mark.parametrize("percent", [90, 80, 70, 60, 50])
def test_links_at_the_threshold_pass_the_sketches(percent):
    """Pairs of 2000 shingles that link exactly: the sketches drop none, whatever the threshold."""
    rng = np.random.default_rng(percent)
    shared = 2000 * percent // 100
    apart = (2000 - shared) // 2
    lost = 0
    for _ in range(150):
        all_ = rng.integers(0, 2**63, 2000, np.int64).view(np.uint64)
        a, b = np.sort(all_[: shared + apart]), np.sort(np.concatenate((all_[:shared], all_[shared + apart :])))
        codes = nd.sketches([a, b])
        n, full = len(a), nd.filled(codes)
        numbers = np.array([[full[0], 0, n, n], [full[1], 0, len(b), len(b)]], float)
        lost += not nd.near(nd.differing(codes[0], codes[1]), numbers[0], numbers[1], percent / 100)
    assert lost == 0


def test_recall_on_a_larger_table(spark):
    """Over 10 000 documents with copies edited to every degree: exact links by an inverted index of all shingles, at 90 and 80."""
    rng = random.Random(12)
    docs, vocabulary = [], [f"{w}{k}" for w in WORDS for k in range(60)]
    while len(docs) < 10_200:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 20, 45, 90]))]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    for n, percent in ((3, 90), (5, 80)):
        sets = {i: shingles(t, n) for i, t in docs}
        holders, up = {}, {i: i for i in sets}
        for i, s in sets.items():
            for x in s:
                holders.setdefault(x, []).append(i)

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        links = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
        links = [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        for a, b in links:
            r, s = root(a), root(b)
            up[max(r, s)] = min(r, s)
        got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df, n, percent).collect()}
        assert len(links) > 1000 and got == {i: root(i) for i in sets}
