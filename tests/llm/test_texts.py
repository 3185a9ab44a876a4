"""Licenses, classifiers, pages and the pipeline."""

import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidra.llm import licenses, quality, site_style, toxicity
from evidra.llm.queries import oracle_sql, queries
from tests.conftest import DATA
from tests.oracle import common, connection


def test_licenses_against_sql(spark):
    got = licenses.op4_license_scan(spark, DATA).toPandas()
    assert common(got) == common(connection(DATA).execute(licenses.SQL).df())


def test_license_phrases(spark, odd, none):
    rows = ["Released UNDER the-MIT license; under the mit license.", "apache license, version 2.0 cc by nc cc by nc", "All rights reserved", "under the mit", None, "Licensed under the Apache License"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [tuple(r)[1:7] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]
    assert got[0] == (9, 2, 1, 5, "mit", "mit") and got[1] == (11, 3, 0, 8, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert got[2] == (3, 0, None, None, "", "proprietary") and got[3][1] == 0 and got[4] == (0, 0, None, None, "", "") and got[5][4] == ""
    assert licenses.scan_licenses(odd).count() == odd.count() and not licenses.scan_licenses(none).collect()


def documents(n=400):
    random.seed(6)
    word = lambda: "".join(random.choices(["an", "er", "on", "th", "in", "re"], k=random.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(random.randint(20, 120))]
        good, toxic = i % 4 != 0, i % 5 == 0
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["grumbold", "snarkle", "vexatrum" + word()]))
        rows.append((i, " ".join(words), int(good), int(toxic)))
    return rows


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def test_quality_held_out(spark, odd, none):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(df.select("doc_id", "text"), model).collect()}
    test = [r for r in rows if held(r[0], 4, 2)]
    assert np.mean([(got[r[0]] >= 0.7) == (r[2] == 1) for r in test]) > 0.97
    scored = quality.score_documents(odd, model)
    assert sorted(scored.columns) == sorted(odd.columns)  # the score takes the place of a column with its name
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert not quality.score_documents(none, model).collect()


def test_machine_uses_the_identity():
    random.seed(1)
    m = quality.Machine(0.1, np.random.default_rng(0).normal(size=quality.BUCKETS + len(quality.STATS)), np.random.default_rng(1).normal(0, 0.1, (quality.BUCKETS + len(quality.STATS), quality.RANK)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    stats, text, bucket, value = quality.features(["some words here some", "", "x!! | y"])
    got = m.raw(stats, text, bucket, value)
    for i in range(3):
        index = np.concatenate((bucket[text == i], np.arange(quality.BUCKETS, len(m.weights))))
        x = np.concatenate((value[text == i], np.clip(stats[i], -6, 6)))
        pairs = sum(m.factors[index[a]] @ m.factors[index[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a + 1, len(x)))
        assert got[i] == pytest.approx(m.bias + m.weights[index] @ x + pairs)


def test_toxicity_held_out(spark, odd, none):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(df.select("doc_id", "text"), chain).collect()}
    test = [r for r in rows if held(r[0], 3, 1)]
    assert np.mean([(got[r[0]]["score"] >= 0.7) == (r[3] == 1) for r in test]) > 0.97
    one = next(r for r in test if r[3])
    spans = [one[1][s["start"] : s["end"]].lower() for s in got[one[0]]["spans"]]
    assert spans and all(s.startswith(("grumbold", "snarkle", "vexatrum")) for s in spans)
    scored = toxicity.score_documents(odd.withColumn("Spans", F.lit(1)), chain)
    assert sorted(scored.columns) == sorted([*odd.columns, "spans"]) and scored.schema["score"].dataType.simpleString() == "double"
    assert scored.count() == odd.count() and scored.where("score is null").count() == 0
    assert not toxicity.score_documents(none, chain).collect()


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.score_documents(df, quality.train(df, labels)).collect()] == pytest.approx([0.5, 0.5])
    assert max(r["score"] for r in toxicity.score_documents(df, toxicity.train(df, labels)).collect()) < 1e-6


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    chain = toxicity.Chain(np.zeros(toxicity.BUCKETS), 0.0, np.array([[0, -1.2], [-0.4, 0.9]]), np.zeros(toxicity.EVIDENCE))
    n = 9
    odds = rng.normal(0, 2, n)
    chain.odds = lambda hashes: odds
    text = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1])
    got = chain.marginals(np.zeros((n, 1), np.uint64), text)
    for t in (0, 1):
        at = np.flatnonzero(text == t)
        weight, total = np.zeros(len(at)), 0.0
        for path in np.ndindex(*(2,) * len(at)):
            s = sum(odds[i] * y for i, y in zip(at, path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(s)
            weight += np.exp(s) * np.array(path)
        assert got[at] == pytest.approx(weight / total)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="ad">Buy</div><div id="cookie-notice">We use</div><article><h1>Head &amp; line</h1><p>One <b>two<br>three<p>Four&nbsp;5 &#233;
six</p><form><input>Go</form><div class="comments"><p>First!</p></div></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_article_text(spark):
    assert site_style.article_text(PAGE, {}) == "Head & line\nOne two three\nFour 5 é six"
    assert site_style.article_text("<div><p>a</p><p>b &lt; c</div>", {}) == "a\nb < c"
    assert [site_style.article_text(x, {}) for x in ("", "plain", "<", "<p", "</div></p>", "<!-- a", "<script>x")] == ["", "plain", "<", "", "", "", ""]


def test_low_branches_go(spark):
    body = lambda i: f"<body><div class=top>Welcome to our site, dear reader of many things</div><div class=c><p>Story {i} tells {i * 7} words and more of it</p></div></body>"
    rows = [(i, "http://a.com/x", body(i), "x") for i in range(12)] + [(50, None, None, "x"), (51, "", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in site_style.extract_pages(df).collect()}
    assert got[3] == "Story 3 tells 21 words and more of it" and got[50] == got[51] == "" and len(got) == 14
    assert not site_style.extract_pages(df.limit(0)).collect()


def test_articles_are_whole():
    text = lambda x: site_style.article_text(x, {})
    assert text("<article><p>x</p></article><article><p>second article</p></article>") == "x\nsecond article"
    assert text("<main><p>intro</p><article><h1>H</h1><p>a</p></article><div class=comments><article><p>no</p></article></div></main>") == "intro\nH\na"
    assert text('<article><section class="related-work"><p>Earlier work</p></section><p class="legal">Law</p><div class="print">Ink</div></article>') == "Earlier work\nLaw\nInk"
    assert text('<article><p>a</p><div class="related"><a href=x>More</a> <a href=y>Yet more</a></div><article class="comment"><p>c</p></article></article>') == "a"


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    assert site_style.article_text("<article>a" * 6000, {}).count("a") == 6000
    deep = "<div class=x>" * 6000 + "<p>deep text</p>"
    assert site_style.article_text(deep, {}) == "deep text" and len(site_style.page_facts(deep)) == 6000
    assert time.time() - began < 10


def planted(i, host):
    """A page whose article holds a box, a list and a weak name; only what varies is text."""
    words = " ".join(f"w{(i * 37 + k * k) % 911}" for k in range(30))
    return f"""<html><body><nav>Menu {i}</nav><article><h1>Title {i}</h1><div class="k{host}"><p>Our house style: every story is checked twice</p></div><p>{words}</p>
<h2>Background</h2><ul class="x1"><li>Back to list</li><li>Home of {host}</li></ul><section class="related-work"><p>Work {i} and {i * 3}</p></section><p class="legal">All of it is ours</p><table><tr><td>{i}</td></tr></table></article></body></html>"""


def cleaned(i):
    words = " ".join(f"w{(i * 37 + k * k) % 911}" for k in range(30))
    return f"Title {i}\n{words}\nBackground\nWork {i} and {i * 3}\n{i}"


def test_boilerplate_without_telling_names_goes(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.com/{i}", planted(i, "ab"[i % 2])) for i in range(40)]
    rows += [(100 + i, "http://copies.com/x", planted(7, "c")) for i in range(12)]  # copies say nothing about their branches
    rows += [(200, "http://alone.com/x", planted(9, "d")), (201, "http://a.com/long", planted(11, "a") * 400), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract_pages(df).collect()}
    assert all(got[i] == cleaned(i) for i in range(40)) and got[201] == "\n".join([cleaned(11)] * 400)
    whole = site_style.article_text(planted(7, "c"), {})
    assert "house style" in whole and "All of it is ours" in whole and all(got[100 + i] == whole for i in range(12)) and got[200] == site_style.article_text(planted(9, "d"), {})
    assert sum(got[r[0]] != site_style.article_text(r[2], {}) for r in rows) == 42  # pages that the trees changed
    assert site_style.extract_pages(df).count() == len(rows)


def test_pages_of_the_smallest_tables(spark):
    rows = site_style.op9_site_style(spark, DATA).collect()
    assert len(rows) == 50 and all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            docs = out.cache()
    assert out.agg(F.count_distinct("doc_id")).first()[0] == docs.count()
    assert corpus_pipeline.run(spark, DATA).count() == out.count()


def test_repeated_ids_dont_enlarge_the_sample(spark):
    from evidra.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")] * 20, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)] * 3, "doc_id long, toxic int")
    assert sorted(map(tuple, labelled_sample(docs, labels, "toxic", 3, 9, 40).collect())) == [("", 1), ("c", 0)]


def test_training_runs_hold_every_token():
    words, at = np.arange(100, dtype=np.int32), np.array([0, 0, 5, 69, 69, 100])
    places, tags = toxicity.training_runs(words, (words % 2).astype(np.int8), at)
    assert places[tags >= 0].tolist() == words.tolist() and len(tags) == 1 + 2 + 1 and (tags[0] >= 0).sum() == 5


def test_training_maximises_the_likelihood():
    """The gradient of one step against the likelihood by enumeration."""
    rng = np.random.default_rng(4)
    n, moves, u = 6, rng.normal(size=(2, 2)), rng.normal(size=6)
    moves[0, 0] = 0
    chain = toxicity.Chain(np.zeros(toxicity.BUCKETS), 0.0, moves, np.zeros(toxicity.EVIDENCE))
    chain.odds = lambda hashes: u
    marginal = chain.marginals(np.zeros((n, 1), np.uint64), np.zeros(n, np.int64))
    score = lambda x: np.log(sum(np.exp(sum(x[i] * y for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))) for path in np.ndindex(*(2,) * n)))
    for i in range(n):
        assert marginal[i] == pytest.approx((score(u + 1e-5 * (np.arange(n) == i)) - score(u)) / 1e-5, rel=1e-3)


def test_cover_leaves_words_that_go_along():
    pairs = [(f, d) for d in range(10) for f in ((0, 2) if d < 6 else (1,))]  # 2 only goes along with 0
    kept = toxicity.cover(np.array([f for f, _ in pairs]), np.array([d for _, d in pairs]), 10, np.array([3.0, 3.0, 2.9]))
    assert sorted(kept.tolist()) == [0, 1]


def odd_documents(spark, n=120):
    """Good and bad documents with nulls, empty and very long texts, repeated ids and rows, and columns that stages use themselves."""
    rows = [(i, t, g, x) for i, t, g, x in documents(n)]
    long = " ".join(f"{w}{i}" for i, w in enumerate(["an", "er", "on", "th"] * 6000))
    more = [(1000, None), (1001, ""), (1001, ""), (1002, " \n "), (1003, long), (1004, long + " end"), (1005, rows[1][1]), (1005, rows[2][1] + " own words of it"), (1006, rows[1][1]), (None, "a text without an id"), (None, None)]
    texts = [(i, t) for i, t, _, _ in rows] + more
    df = spark.createDataFrame([(i, t, "x", 0.5, ["s"], 7, "h", 1) for i, t in texts], "doc_id long, text string, source string, score double, spans array<string>, _row int, text_hash string, component_id int")
    return df, spark.createDataFrame([(i, g, x) for i, _, g, x in rows], "doc_id long, quality int, toxic int")


def test_stages_take_odd_documents(spark, tmp_path):
    docs, labels = odd_documents(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()]
    ids = [i for i, _ in left]
    assert 1003 in ids and 1004 not in ids and 1006 not in ids and 1 in ids  # copies go
    assert [t for i, t in left if i == 1005] == [next(r["text"] for r in docs.collect() if r["doc_id"] == 1005 and r["text"].endswith("own words of it"))] or 1005 not in ids
    assert ids.count(None) == 2 and {1000, 1001, 1002} <= set(ids) and len(set(left)) == len([x for x in left if x[0] is not None]) + len({x for x in left if x[0] is None})


def test_empty_pipeline(spark, tmp_path):
    docs, labels = odd_documents(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_held_out_is_crc32(spark):
    from evidra.llm.labelled import held_out

    rows = spark.range(500).select("id", held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r["h"] == held(r["id"], 3, 1) for r in rows)


def test_sample_is_bounded_and_skips_held_out(spark):
    from evidra.llm.labelled import labelled_sample

    docs = spark.range(300).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    rows = labelled_sample(docs, labels, "toxic", 3, 1, 40).collect()
    assert len(rows) == 80 and not any(held(r["_text"].split()[1], 3, 1) for r in rows)


def test_quotes_in_bare_values_end_nothing():
    page = "<article><p title=don't>First one.</p><p>Second isn't <b class='x' data-a=\"it's\">bold</b>.</p><p data-hidden=1 nothidden>third.</p><p hidden>gone</p><img alt=a/b/>x<br/>y</article>"
    assert site_style.article_text(page, {}) == "First one.\nSecond isn't bold.\nthird.\nx y"
    assert site_style.article_text('<article><p title="open>a</p><p>b</p>', {}) == "a\nb"


def test_noise_is_told_before_article_names():
    for name in ("sidebar content", "footer-content", "newsletter-body", "ad content", "main-menu", "share content", "post-comments", "content comments"):
        assert site_style.article_text(f"<article><p>stays</p><div class='{name}'>goes</div></article>", {}) == "stays"
    for name in ("content has-sidebar", "with-menu post", "article-body", "main-content", "post no-header", "entry-text"):
        assert site_style.article_text(f"<body><div class='{name}'><p>stays</p></div><footer>goes</footer></body>", {}) == "stays"


@pytest.mark.parametrize(
    "page",
    ["<b>" * 16_000 + "</i>" * 16_000, "<article>" * 16_000, "<p><tr>" + "<b>" * 8000 + "<div></div>" * 8000, "<ul><li>" * 8000 + "</b>" * 8000, "<a b='" * 16_000, "<td>" * 16_000 + "</table>" * 16_000, "<dl>" + "<dt><i>" * 8000, "<x " + "a " * 50_000],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    site_style.article_text(page, {})
    site_style.page_facts(page)
    assert time.process_time() - began < 3


class Plain(HTMLParser):
    """A slow reader of its own: blocks of text of the article, without elements whose tag or class says they are none."""

    VOID = {"br", "img", "meta", "link", "hr", "input"}
    NOISE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "iframe", "button", "select", "textarea", "head", "title"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], []
        self.inside = re.search(r"<(article|main)\b", page, re.I)
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        told = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        noise = tag in self.NOISE or bool(re.search(r"\b(ads?|advert|nav|navigation|menu|sidebar|footer|header|cookie|comments?|share|social|promo|banner|newsletter|related|popup|modal|breadcrumbs?)\b", told, re.I))
        if tag not in ("b", "i", "a", "em", "strong", "span", "br", "img", "code", "u"):
            self.cut()
        if tag == "br":
            self.now.append(" ")
        if tag not in self.VOID:
            self.stack.append((tag, noise))

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span", "code", "u"):
            self.cut()
        while any(t == tag for t, _ in self.stack) and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        article = not self.inside or any(t in ("article", "main") for t, _ in self.stack)
        if article and not any(noise for _, noise in self.stack):
            self.now.append(data)


def test_given_pages_as_a_plain_reader_has_them(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    got = {r["page_id"]: r["text"] for r in site_style.op9_site_style(spark, folder).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert got.keys() == pages.keys()
    assert {i: "\n".join(Plain(p or "").blocks) for i, p in pages.items()} == got
