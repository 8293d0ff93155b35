"""op3, op5 and op8: held-out accuracy, and defined results for odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import html, language, quality
from factorloom.llm.common import table

BIG = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, BIG, "documents")
    got = language.op5_language_id(spark, BIG).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es"} and all(0 <= r.score <= 1 for r in got)


def test_language_rejects_and_odd_rows(spark):
    docs = table(spark, BIG, "documents")
    model = language.fit(docs, per_label=100)
    rows = [(1, None, 1.0), (2, "", 1.0), (3, " 12 %% 7", 1.0), (4, "ппрдвалоы йцукен гшщзхъ " * 40, 1.0), (5, "The that of and with erentionst the is " * 9, 1.0), (None, "x" * 2_500_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("LANG_PRED", F.lit("mine"))
    made = language.identify(df, model)
    assert made.columns == ["doc_id", "text", "score", "LANG_PRED", "lang_pred_1", "score_1", "rejected"]
    got = {r.doc_id: r for r in made.withColumnsRenamed({"score": "old", "LANG_PRED": "mine"}).withColumnsRenamed({"lang_pred_1": "lang_pred", "score_1": "score"}).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in (1, 2, 3))
    assert got[4].rejected and got[4].lang_pred != "und" and not got[5].rejected and got[5].lang_pred == "en"
    assert language.identify(df.limit(0), model).count() == 0 and len(got) == 6
    held = df.select("doc_id", language.held_out().alias("h")).collect()
    assert {r.doc_id: r.h for r in held}[None] is True


def test_language_sample_is_bounded_and_repeatable(spark):
    docs = table(spark, BIG, "documents")
    a, b = language.fit(docs, per_label=30), language.fit(docs.repartition(9), per_label=30)
    np.testing.assert_array_equal(a.centres, b.centres)
    hot = spark.createDataFrame([("the same text", "en")] * 500 + [("otro texto con ñ", "es")], "text string, lang string")
    assert language.fit(hot, per_label=20).langs == ["en", "es"]
    many = spark.createDataFrame([(f"text {'abcdefghij'[n % 10]}{n}", f"l{n % 300}") for n in range(900)], "text string, lang string")
    assert len(language.fit(many, per_label=5).langs) == 300 == len(language.fit(many, per_label=5, rows=100).langs)
    assert language.fit(docs.limit(0)).predict("any") == ("und", 0.0, True)


def test_counts_do_not_depend_on_blocks(monkeypatch):
    random.seed(1)
    text = "".join(random.choice("abcé ñ1") for _ in range(500))
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "BLOCK", 64)
    np.testing.assert_array_equal(language.ngram_counts(text), whole)


def test_language_is_the_plain_cosine(spark):
    """Every row of the query against weights, cosines and the nearest centroid written out."""
    docs = table(spark, BIG, "documents")
    model = language.fit(docs.where(~language.held_out()), draw=F.xxhash64("doc_id"))
    centres = model.centres.astype(np.float64)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-4) and len(centres) == 16
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.op5_language_id(spark, BIG).collect():
        text = (texts[r.doc_id] or "").lower()
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        counts = language.ngram_counts(text)
        w = np.where(counts > 0, 1 + np.log(np.maximum(1, counts)), 0) * model.idf
        cosines = centres @ (w / np.sqrt((w * w).sum()))
        assert abs(r.score - cosines.max()) < 1e-4 and cosines[model.names == model.langs.index(r.lang_pred)].max() > cosines.max() - 1e-4


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_held_out(spark):
    labels = table(spark, BIG, "labels")
    got = quality.op3_quality(spark, BIG).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["quality"] for r in got]), np.array([r["score"] for r in got])
    assert auc(s, y) > 0.9 and all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert ((s - y) ** 2).mean() < ((y - y.mean()) ** 2).mean()


def test_quality_is_the_plain_forward_pass(spark):
    """Every row of the query against pooling and network written out word by word."""
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    model = quality.fit(docs, labels, ~quality.held_out())
    net, texts, index = model.net, {r.doc_id: r.text for r in docs.collect()}, quality.index_vectors()
    assert (np.count_nonzero(index, axis=1) == quality.ONES).all() and np.allclose((index**2).sum(1), 1)
    for r in quality.op3_quality(spark, BIG).where("doc_id % 5 = 0").collect():
        found = quality.words(texts[r.doc_id])
        vector = lambda w: model.words.vectors[model.words.places[w]] if w in model.words.places else index[zlib.crc32(w.encode()) & 0xFFFF]
        x = np.zeros(2 * quality.SIZE + 6)
        if found:
            once = list(dict.fromkeys(found))
            every, single = np.mean([vector(w) for w in found], 0, np.float64), np.mean([vector(w) for w in once], 0, np.float64)
            strange = [w not in model.words.places for w in found]
            x = np.concatenate([every, single, [np.linalg.norm(every - single), max(map(found.count, once)) / len(found), np.mean(strange), np.mean([w not in model.words.places for w in once]), np.log(1 + len(found)), np.log(1 + len(once))]])
        z = np.tanh((x - net.mean) / net.scale @ net.p[0] + net.p[1]) @ net.p[2] + net.p[3][0]
        assert abs(r["score"] - 1 / (1 + np.exp(-z / model.temperature))) < 1e-3


def test_quality_learns_from_long_and_empty_texts_and_repeats(spark):
    rows = [(1, "word " * 20_000, 1), (2, "", 0), (3, None, 0), (4, "a b", 1), (4, "A z", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    seen = []
    plain = quality.QualityModel.__init__
    quality.QualityModel.__init__ = lambda self, texts, y: (seen.append((texts, y.tolist())), plain(self, texts, y))[1]
    try:
        for n in (1, 5):
            quality.fit(docs.repartition(n), labels, F.lit(True))
    finally:
        quality.QualityModel.__init__ = plain
    assert seen[0] == seen[1] and sorted(zip(*seen[0], strict=True)) == [("", 0.0), ("", 0.0), ("A z", 1.0), ("word " * 20_000, 1.0)]


def test_quality_odd_rows():
    model = quality.QualityModel(["good plain words here"] * 30 + ["$$$ ### %%%"] * 30, np.array([1.0] * 30 + [0.0] * 30))
    s = model.scores(["good plain words", "### $$$", None, "", "x " * 300_000])
    assert s[0] > 0.7 > s[1] and ((s >= 0) & (s <= 1)).all()
    assert quality.QualityModel([], np.array([])).scores(["a"])[0] == 0.5
    assert quality.QualityModel(["a", "b"], np.array([1.0, 1.0])).scores(["z", None]).tolist() == [1.0, 1.0]


def test_quality_frame(spark):
    docs = spark.createDataFrame([(n, "good words here and there" if n % 2 else "### $$$ ###", "x") for n in range(60)] + [(None, None, None)], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(60)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, ~quality.held_out(), rows=40)
    assert quality.score(docs, model).columns == ["doc_id", "text", "SCORE", "score_1"] and quality.score(docs, model).count() == 61 and quality.score(docs.limit(0), model).count() == 0


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    one = html.Lstm(5, 3, rng)
    one.p = [p.astype(np.float64) for p in one.p]
    x, mask = rng.normal(size=(2, 4, 5)), np.array([[1.0, 1, 1, 1], [1, 1, 0, 0]])
    weight = rng.normal(size=(2, 4, 3)) * mask[:, :, None]
    loss = lambda: float((one.forward(x, mask)[0].astype(np.float64) * weight).sum())
    _, trace = one.forward(x, mask, True)
    grads, along = one.backward(x, trace, weight)
    for p, g in zip([*one.p, x], [*grads, along], strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)]:
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_pages(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=/a>Home</a></nav><div class='cookie-banner'>We use cookies.</div><article><h1>A &amp; B</h1><p>First   para\n graph &lt;x&gt; &eacute;.<p>Second one <b>bold</b>.<div class=ad>Buy now, cheap things.</div></article><section id=comments><p>I liked this a lot, thank you.</p></section><footer>&copy; someone</footer>"
    rows = [(1, "u", page, "x"), (2, None, None, None), (3, "u", "", ""), (4, "u", "<nav><a>x</a></nav>", "y"), (1, "u", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    again = html.extract(df.withColumnRenamed("text", "MAIN_TEXT"))
    assert again.columns == ["page_id", "url", "html", "MAIN_TEXT", "main_text_1"] and sorted(r.main_text_1 for r in again.collect()) == sorted(r.main_text for r in got)
    assert sorted(r.main_text for r in got) == sorted(["A & B\nFirst para graph <x> é.\nSecond one bold."] * 2 + [""] * 3)
    assert html.extract(df.limit(0)).count() == 0


def test_invented_pages_held_out():
    source = html.Invented(4242)
    right = every = 0
    for text, labels in [source.page() for _ in range(80)]:
        rows = html.blocks(text)
        if rows:
            p = html.trained().probabilities([html.Rows(rows)])[0]
            right, every = right + int(((p >= 0.5) == np.array(labels)).sum()), every + len(labels)
    assert right / every > 0.96


def test_batches_do_not_change_labels():
    pages = [html.Invented(5).page()[0] for _ in range(3)] + ["", None, "<p>one</p>"] + [html.Invented(6).page()[0]]
    model = html.trained()
    assert html.main_texts(pages, model) == [html.main_texts([p], model)[0] for p in pages] == html.main_texts(pages, model, cells=1)


def test_article_of_the_tables_pages(spark):
    import re
    from html import unescape

    def plain(text):
        inside = re.search(r"<article>(.*?)(</article>|$)", text, re.S)[1]
        parts = (re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
        return "\n".join(x for x in parts if x)

    pages = {r.page_id: r.html for r in table(spark, BIG, "pages").collect()}
    got = html.op8_html_text(spark, BIG).collect()
    assert len(got) == len(pages) and all(r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)
    assert html.op8_html_text(spark, BIG).where(F.col("n_chars") != F.length("text")).count() == 0


def test_omitted_end_tags_and_formulas_lose_no_block():
    told = lambda page: [b.text for b in html.blocks(page)]
    assert told("<html><head><title>t</title><body><p>One<p>Two <math><mi>x</mi></math> three") == ["One", "Two x three"]
    assert told("<head><title>t</title><style>a</style><p>One</p></head>Two") == ["One", "Two"]
    assert told("<head><meta charset=utf-8><title>t</title>Bare text<ul><li>a<li>b</ul>") == ["Bare text", "a", "b"]
    assert told("<head><noscript><img src=a>no</noscript><title>t</title></head><body><p>One") == ["One"]


def test_every_word_of_a_block_counts():
    texts = ["One, two three.", "", "two", "ÄÖ two (one)! one", "x" * 5000 + " three"]
    bins, counts = html.word_bins(texts)
    assert counts.tolist() == [3, 0, 1, 4, 2] and bins[0] == bins[6] == bins[7] and bins[1] == bins[3] == bins[5] and bins[2] == bins[9]
    long = html.blocks("<p>" + "word " * 50 + "middle " + "word " * 50)
    page = html.Rows(long)
    vectors = np.random.default_rng(1).normal(size=(html.WORD_BINS, html.WORD_SIZE)).astype(np.float32)
    said = page.inputs(vectors)[0, html.PATH_BINS : html.PATH_BINS + html.WORD_SIZE]
    np.testing.assert_allclose(said, vectors[page.bins].mean(0), rtol=1e-4, atol=1e-5)
    assert len(page.bins) == 101 and len(set(page.bins.tolist())) == 2


def test_gradient_of_the_word_vectors():
    rows = [html.Rows(html.blocks(p)) for p in ("<p>a b c<p>b", "<div>c c a")]
    model, said = html.Labeller(), np.random.default_rng(2).normal(size=(2, 2, html.WORD_SIZE)).astype(np.float32)
    want = np.zeros_like(model.vectors)
    for d, page in zip(said, rows, strict=True):
        at = 0
        for k, n in enumerate(page.words):
            for b in page.bins[at : at + n]:
                want[b] += d[k] / n
            at += n
    np.testing.assert_allclose(model.word_gradient(said, rows), want, rtol=1e-4, atol=1e-6)


def test_zero_width_spaces_and_fallbacks_stay():
    told = lambda page: [b.text for b in html.blocks(page)]
    assert told("<article><p>one\u200btwo  three\u00a0four</p><object>shown</object><noscript>plain</noscript></article>") == ["one\u200btwo three four", "shown", "plain"]


def test_very_deep_and_very_long_pages():
    """Half a million blocks, and 50,000 open tags: no copies of ancestors, no page held at once."""
    import tracemalloc

    model = html.trained()
    deep = "<article>" + "<div class=x>word" * 50_000
    tracemalloc.start()
    found = html.blocks(deep)
    assert len(found) == 50_000 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    short = html.blocks("<nav><a>x</a></nav><article>" + "<p>Some words, and more of them.</p>" * 300 + "</article><footer>© a</footer>")
    np.testing.assert_allclose(model.probabilities_of_long(short, 64), model.probabilities([html.Rows(short)])[0], atol=1e-4)
    long = "<nav><a>x</a></nav><article>" + "<p>Some words.</p>" * 500_000 + "</article>"
    text = html.main_texts([long], model)[0]
    assert text.count("\n") == 499_999


def test_weights_are_stored_once(spark, monkeypatch):
    a = html.trained(pages=20, seed=1, spark=spark)
    html._TRAINED.pop((20, 1))
    monkeypatch.setattr(html.Labeller, "train", None)
    b = html.trained(pages=20, seed=1, spark=spark)
    assert a is not b and all((x == y).all() for x, y in zip(a.params(), b.params(), strict=True))
