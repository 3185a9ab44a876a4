"""Spelling variants against brute force over the vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidra.llm import spelling as sp
from tests.conftest import DATA


def lowered(run):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)


def counted(docs, flaws=199):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % flaws == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(counts):
    words = {w: n for w, n in counts.items() if n >= 5}
    holes = {}  # words meet where one letter is left out of one or both
    for w in words:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        holes.setdefault(w, set()).add(w)
    out = {}
    for w, n in words.items():
        met = set().union(*(holes.get(x, set()) for x in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))]))
        near = [x for x in met if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aAbeéÈnrßx") for _ in range(rng.randint(4, 12)))
    bag = []
    for _ in range(150):
        base, often = word(), rng.choice([6, 40, 400, 3000])
        while often >= 5 and len(bag) < 60_000:
            bag += [base] * often
            k = rng.randrange(len(base) + 1)
            base = rng.choice([base[:k] + rng.choice("abxé") + base[k:], base[: max(0, k - 1)] + base[k:], base[:k] + "n" + base[k + 1 :]])
            often //= rng.choice([2, 5, 6])
    long = "q" * 3000
    bag += [long] * 6 + [long + "q"] * 40 + ["zzzzzz"] * 20_000
    rng.shuffle(bag)
    return [(i, rng.choice([" ", ", ", "1", "漢", "\n"]).join(bag[k : k + 500])) for i, k in enumerate(range(0, len(bag), 500))]


@pytest.mark.parametrize("flaws", [199, 3])
def test_variants(spark, flaws):
    docs = [*corpus(1), (None, "Wanted wanted WANTED wanted wanted"), (7, None), (8, ""), (9, "short"), (9, "short")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(6)
    counts = sp.counts_of(df, flaws=flaws)
    want = counted(docs, flaws)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    found = brute(want)
    assert result(sp.group_variants(counts)) == found
    assert any(v[1] != w and v[1] != v[0] for w, v in found.items())  # chains of forms occur


@pytest.mark.parametrize("symbols,crowd", [(1, 256), (4, 3), (2, 0), (9, 256)])
def test_any_alphabet_and_crowd(spark, symbols, crowd):
    counts = {w: n for w, n in counted(corpus(2)).items() if n >= 5 and len(w) < 50}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").cache()
    pairs = [(r["word"], r["near"], r["near_n"]) for r in sp.near_words(df, symbols, crowd).collect()]
    want = {(a, b, counts[b]) for a in counts for b in counts if one_edit(a, b)}
    assert len(pairs) == len(want) and set(pairs) == want


def test_codes_spell_out(spark):
    """Codes of neighbourhoods are those of the reduced words themselves."""
    flat = lambda words: {len(words[0]): sp.reduced_codes(words, 5)}
    for word in ("banana", "àéîõüß", "aaaaaa"):
        symbols = sp._symbols([word], 5)[0]
        letter = {}
        for c in map(chr, range(97, 123)):
            letter.setdefault(int(sp._symbols([c], 5)[0, 0]), c)
        plain = "".join(letter[int(s)] for s in symbols)
        variants = {plain} | {plain[:k] + plain[k + 1 :] for k in range(6)} | {plain[:k] + c + plain[k + j :] for k in range(7) for j in (0, 1) if k + j <= 6 for c in letter.values()}
        want = {int(sp.reduced_codes([v], 5)[0]) for v in variants}
        assert set(np.concatenate(list(sp.neighbour_codes([word], 5)), 1)[0].tolist()) == want
        assert flat([word])[6][0] == flat([plain])[6][0]


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert result(sp.op12_spelling_variants(spark, DATA)) == brute(counted(docs))


def test_odd(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(sp.group_variants(sp.counts_of(odd))) == brute(counted(rows))
    assert sp.group_variants(sp.counts_of(none)).collect() == []
