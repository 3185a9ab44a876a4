"""Composition and folding against Python's, on every code point and on random sequences."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from evidra.functions.unicode import casefold, nfc, squeezed


def run(spark, texts, *made):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    return {r[0]: r[1:] for r in df.select("i", *(m(F.col("t")) for m in made)).toLocalIterator()}


def test_every_code_point(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (c < 0x32000 or 0xE0000 <= c < 0xE0200)]
    got = run(spark, chars, nfc, casefold)
    wrong = [(hex(ord(c)), got[i]) for i, c in enumerate(chars) if got[i] != (unicodedata.normalize("NFC", c), c.casefold())]
    assert wrong == []


def test_sequences(spark):
    rng = random.Random(3)
    marks = [chr(c) for c in range(0x300, 0x345)] + ["ཱ", "ཱི", "ཱྀ", "़", "া", "ா", "゙"]
    bases = list("aeoAßİΣσçéễ가각힣") + ["ᄀ", "ᄒ", "ᅡ", "ᅵ", "ᆨ", "ᇂ", "ে", "ெ", "क़", "か", "Å", "Ω", "\U0001d15e", "漢", " ", "1"]
    texts = ["".join(rng.choice(marks if rng.random() < 0.5 else bases) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += [unicodedata.normalize("NFD", t) for t in ("영업팀/실적 보고서.xlsx", "Ångström Größe ΑΣ Σ", "각힣" * 40)] + ["", "plain"]
    got = run(spark, texts, nfc, casefold)
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != (unicodedata.normalize("NFC", t), t.casefold())]
    assert wrong == []


def test_white_space(spark):
    texts = [" a 　 b\t\n", " x\x1cy\x85", "a​b", "", " "]
    got = run(spark, texts, squeezed)
    assert [got[i][0] for i in range(len(texts))] == [" ".join(t.split()) for t in texts]


def test_folding_works_its_text_out_once(spark):
    """What is folded stands once in the plan, however many cases there are; runs of other letters between ASCII fold as in whole texts."""
    texts = ["", None, "Straße ΑΣ x ς", "ABC", "a\u0130b", "ﬁN가나Ǆ\u0345🙂Z", "Ꭰꭰ ΣΣ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", casefold(F.regexp_replace("t", "x", "X")).alias("f"))
    assert {r["i"]: r["f"] for r in df.collect()} == {i: None if t is None else t.replace("x", "X").casefold() for i, t in enumerate(texts)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t") == 1
