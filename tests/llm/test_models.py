"""Language, toxicity and page text: held-out accuracy, defined cases and literal expectations."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import crf, html_text, language, queries, toxicity


def test_switching_keeps_short_words_in_their_span():
    score = np.array([[[0.0, -9.0]], [[-1.0, 0.0]], [[0.0, -9.0]], [[-9.0, 0.0]], [[-9.0, 0.0]]])
    there = np.ones((5, 1), bool)
    assert language.spans(score, there, 3.0)[:, 0].tolist() == [0, 0, 0, 1, 1]
    there[3:] = False
    score[3:] = 0
    assert language.spans(score, there, 3.0)[:3, 0].tolist() == [0, 0, 0]


def test_language(spark, odd, empty):
    r = random.Random(2)
    vocab = {"en": "the and of with this house water", "fr": "le la des avec cette maison eau", "ru": "и в не на дом вода с", "el": "και το η με σπίτι νερό"}
    rows = []
    for i in range(120):
        lang = list(vocab)[i % 4]
        rows.append((i, " ".join(r.choices(vocab[lang].split(), k=30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") < 100)
    assert model["langs"] == ["el", "en", "fr", "ru"]
    got = {x.row.doc_id: (x.lang_pred, x.score) for x in language.predict(docs, model).collect()}
    assert all(got[i] == (lang, 1.0) for i, _, lang in rows)
    mixed = spark.createDataFrame([(1, "the house with water and the " * 6 + "с вода в дом и " * 3)], "doc_id long, text string")
    one = language.predict(mixed, model).first()
    assert one.lang_pred == "en" and one.n_spans == 2 and 0.5 < one.score < 1
    for x in language.predict(odd, model).collect():
        lettered = any(c.isalpha() for c in x.row.text or "")
        assert (x.lang_pred == "und") == (not lettered) and 0 <= x.score <= 1
        assert lettered or x.score == 0
    assert language.predict(empty, model).count() == 0
    none = language.fit(empty, F.lit(True))
    assert {x.lang_pred for x in language.predict(odd, none).collect()} == {"und"}


def test_spans_of_a_mixed_text(spark):
    words = {"en": "the house and that with which this there", "de": "das haus und nicht eine auch werden über", "ru": "это дом также который было его они"}
    r = random.Random(6)
    text = lambda lang, n: " ".join(r.choices(words[lang].split(), k=n))
    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(["en", "de", "ru"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    parts = [("en", text("en", 12)), ("ru", text("ru", 3)), ("de", text("de", 12)), ("en", text("en", 9))]
    mixed = "  " + "\n".join(p for _, p in parts) + " "
    found = language.predict(spark.createDataFrame([(1, mixed), (2, ""), (3, None), (4, " 12 ")], "doc_id long, text string"), model).collect()
    by = {x.row.doc_id: x for x in found}
    assert [(s.lang, mixed[s.start : s.end]) for s in by[1].spans] == parts and by[1].n_spans == 4
    assert by[2].spans == by[3].spans == [] and all(x.n_spans == len(x.spans) for x in found)


def test_language_ignores_what_it_must_not_learn(spark, sf):
    """Labels of held-out documents change nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = toxicity.fold(F.col("doc_id"), 3) == 1
    changed = docs.withColumn("lang", F.when(held, F.lit("en")).otherwise(F.col("lang")))
    one, two = (language.fit(d, ~held) for d in (docs, changed))
    assert one["langs"] == two["langs"] and np.array_equal(one["table"], two["table"])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.QUERIES["op3_language_id"](spark, sf).collect()
    assert len(found) == len(docs)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.97 * len(held)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_pieces_of_a_chain_change_no_marginal(size):
    draw = np.random.default_rng(size)
    counts = np.array([0, 1, 2, 63, 64, 65, 0, 400, 129, 5, 0])
    first = np.concatenate([[0], np.cumsum(counts)])
    for k in (2, 4):
        score = 3 * draw.standard_normal((first[-1], k))
        transition, start = 3 * draw.standard_normal((k, k)), 3 * draw.standard_normal(k)
        got = crf.chain_marginals(score, first, transition, start, size=size, rows=256)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b > a:
                there = np.ones((b - a, 1), bool)
                want = crf.forward_backward(score[a:b, None, :], there, transition, start, pairs=False)[0][:, 0]
                assert np.allclose(got[a:b], want, atol=1e-9)


def test_toxicity(spark, odd, empty):
    r = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        words = r.choices(plain, k=40)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words[r.randrange(40)] = r.choice(["vileword", "nastyword", "badwordly", "badwordful"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 200)
    got = {x.row.doc_id: x for x in toxicity.score(docs, model).collect()}
    for i, text, toxic in rows:
        assert (got[i].score >= 0.5) == bool(toxic)
        found = [text[s.start : s.end] for s in got[i].spans]
        assert all("word" in w for w in found) and bool(found) == bool(toxic)
    odd_scores = toxicity.score(odd, model).collect()
    assert len(odd_scores) == odd.count() and all(0 <= x.score <= 1 for x in odd_scores)
    assert toxicity.score(empty, model).count() == 0
    for some in (labels.where("toxic = 0"), labels.where("false")):
        nothing = toxicity.fit(docs, some, F.lit(True))
        assert {x.score for x in toxicity.score(odd, nothing).collect()} == {0.0}


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.QUERIES["op8_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) > 0.93 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) for r in found)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="page-12"><header><h1>Site</h1></header><nav><ul><li><a href="/">menu</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more</div><!-- <p>no</p> -->
<div class="post-77 main"><h2>Head &eacute;&#33;</h2><p>First <b>bold</b>,
  text<br>goes&nbsp;on.<p>Second one with enough words to be the article of the page.<aside>see also</aside>
<ul><li>item one<li>item two</ul><form><input name=q> search</form><p>Third &lt;tag&gt; and <a href=x>link</a>.</p></div>
<section id="comments"><p>a reader says a lot of things here that are not part of the article at all, really</p></section>
<footer>&copy; 2020</footer>"""
WANT = "Head é!\n\nFirst bold, text goes on.\n\nSecond one with enough words to be the article of the page.\n\nitem one\n\nitem two\n\nThird <tag> and link."


def test_page_text():
    assert html_text.page_text(html_text.blocks(PAGE), None) == WANT
    for broken in ("", "no markup", "<", "<p", "<p><p></p></div>", "<script>x", "<!-- x", "<a <a <a", "&bogus; &amp"):
        html_text.page_text(html_text.blocks(broken), None)
    assert html_text.page_text(html_text.blocks("<p>a</p>b<div>c"), None) == "a\n\nb\n\nc"
    assert html_text.page_text(html_text.blocks("<p>" + "x" * 200000 + "<p>" * 50000), None) == "x" * 200000


def test_consensus(spark):
    """The host's path wins over a page's own longest container."""
    page = '<body><div class="story-{0}"><p>{1}</p></div><div class="extra"><p>{2}</p></div></body>'
    rows = [(i, f"http://h.example/p{i}", page.format(i, "long " * 30, "short")) for i in range(5)]
    rows.append((9, "http://H.example:80/odd", page.format(9, "tiny", "much longer " * 40)))
    rows += [(10, None, "<p>alone</p>"), (11, "http://h.example/none", "<main><p>other kind of page</p></main>"), (12, "x", None), (13, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r.host: r.path for r in html_text.host_paths(pages).collect()}
    assert paths["h.example"] == ">body>div.story"
    got = {r.row.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[9] == "tiny" and got[10] == "alone" and got[11] == "other kind of page" and got[12] == got[13] == ""
    clash = pages.withColumn("text", F.lit("own")).withColumn("host", F.lit("own"))
    assert html_text.extract(clash.union(clash)).count() == 20
    assert html_text.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op3_language_id", "op8_toxicity", "op10_html_extraction"])
def test_every_row_is_answered(spark, sf, name):
    table = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
