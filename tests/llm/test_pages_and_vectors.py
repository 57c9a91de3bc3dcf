import html
import re

import numpy as np
import pytest

from expirylens.llm import html_extraction as H, language as L
from expirylens.llm.neighbours import nearest
from expirylens.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies, as everybody does. Please agree, now.</p></div>
<article><header><h1>A  title</h1></header><p>First &amp; longest paragraph, with <b>bold</b> words<br>and a break. It goes on, and on.
<p>Second&nbsp;one: unclosed <i>inline. <ul><li>item one<li>item two</ul><script>if (a < b) { x("</p>") }</script>
<form><p>Sign up, please. It is free, quick.</p></form></article>
<aside><p>Other stories, of other people. All of them.</p></aside><div id="comments"><p>Nice, thanks! I liked it, really.</p></div>
<footer>&copy; 2020</footer></body></html><foo"""


def test_main_text_of_a_page():
    text, paths = H.main_text(PAGE)
    assert text == "A title First & longest paragraph, with bold words and a break. It goes on, and on. Second one: unclosed inline. item one item two"
    assert all("article" in p for p in paths)


def test_a_page_of_plain_divisions():
    page = ("<div class=x><a href=1>Home</a> <a href=2>News</a></div><div class=y><h2>Title</h2><div class=t>"
            + "</div><div class=t>".join(["A sentence, then another. And more, with commas, of course."] * 4)
            + "</div></div><div class=z>Imprint</div>")
    assert H.main_text(page)[0] == "Title " + " ".join(["A sentence, then another. And more, with commas, of course."] * 4)


BODY = "<h1>Title here</h1><p>One sentence, and another one. It goes on, as they do.</p><p>A second paragraph, with words; and marks.</p>"
TEXT = "Title here One sentence, and another one. It goes on, as they do. A second paragraph, with words; and marks."


@pytest.mark.parametrize("open_,close", [
    ('<div class="page has-sidebar"><article>', "</article></div>"), ('<div id="content" class="with-sidebar">', "</div>"), ('<div class="layout--no-sidebar"><main>', "</main></div>"),
    ('<form id="aspnetForm"><div>', "</div></form>"), ('<form><article>', "</article></form>"), ('<div class="sidebar-left-page"><article>', "</article></div>"), ("<article>", "</article>")])
def test_wrappers_named_like_asides_hold_the_article(open_, close):
    around = '<nav><a href="/">Home</a></nav><div class="sidebar"><p>Other news, of today. See more.</p></div>'
    foot = '<div class="comments"><p>I liked it, really. Thanks, all of you!</p></div><div class="ad"><p>Buy now, cheap.</p></div><footer>Imprint</footer>'
    assert H.main_text(f"<html><body>{around}{open_}{BODY}{close}{foot}</body></html>")[0] == TEXT


def test_parts_of_an_article_stay():
    page = f'<article>{BODY}<section id="related-work"><p>Others did this, before us. We cite them.</p></section><p>Let <math><mi>x</mi></math> be <object>an object</object>, and <canvas>a sketch</canvas>.</p></article>'
    assert H.main_text(page)[0] == TEXT + " Others did this, before us. We cite them. Let x be an object, and a sketch."


def test_given_pages_without_article_elements(spark):
    good = total = found = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = H.main_text(r.html)[0].split()
        got = H.main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html))[0].split()
        good += len([w for w in got if w in set(want)])
        total, found = total + len(want), found + len(got)
    assert good / total > 0.98 and good / found > 0.98


def test_ratios_by_hand():
    found = [("/a", "abcd, ef.", (), 0), ("/b", "xyz", (), 3), ("/a", "gh!", (), 0)]
    paths, of, ratio = H.ratios(found)
    length = [(9 + 3) / 2, 0.0]
    marks = [(2 + 1 + 1) / 2, 1.0]

    def smooth(x):
        own = [x[k] for k in of]
        padded = [own[0]] * 2 + own + [own[-1]] * 2
        out = [sum(w * padded[i + j] for j, w in enumerate((0.05, 0.25, 0.4, 0.25, 0.05))) for i in range(3)]
        return [(out[0] + out[2]) / 2, out[1]]
    assert paths == {"/a": 0, "/b": 1} and of.tolist() == [0, 1, 0]
    assert np.allclose(ratio, [np.sqrt(length[k] * smooth(length)[k]) * np.sqrt(marks[k] * smooth(marks)[k]) for k in (0, 1)])


def test_a_very_long_page():
    page = f"<body><nav>{'<a href=x>link</a>' * 20000}</nav><article>{'<p>Words, and more words.</p>' * 40000}</article></body>"
    assert H.main_text(page)[0] == " ".join(["Words, and more words."] * 40000)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p>", "text", "<script>x", "<a b='>", "&#0;&bogus;&amp", "<p>" * 3000 + "x", "<!-- x", "</p></div>", "a" * 300_000, "<a b=\"" * 5000])
def test_broken_pages(page):
    assert isinstance(H.main_text(page)[0], str)


def test_html_of_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (2, "u", PAGE, None), (2, "u", PAGE, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, len(H.main_text(PAGE)[0]), len(H.main_text(PAGE)[0])]
    assert H.extract(df.limit(0)).count() == 0


def test_html_query_returns_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_html"](spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == " ".join(filter(None, parts)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def exact(rows, k=5):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good.items():
        if q % 50 == 0:
            scores = [(-float(a @ b / np.sqrt((a @ a) * (b @ b))), i) for i, b in good.items() if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_recall_of_the_query(spark, sf):
    want = exact([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    rows = QUERIES["op4_neighbours"](spark, sf).collect()
    got = {(r.query_id, r.vec_id): r.score for r in rows}
    pairs = {(q, i): s for q, found in want.items() for i, s in found}
    assert len(got.keys() & pairs.keys()) >= 0.95 * len(pairs) and len(got) == len(pairs)
    assert all(abs(got[p] - pairs[p]) < 1e-12 for p in got.keys() & pairs.keys())
    for q in want:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_recall_over_shards_and_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + rng.normal(size=24) * rng.choice([0.05, 0.4])).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest(df, df["vec_id"] % 50 == 0, shard_vectors=700).collect()}
    want = {(q, i) for q, found in exact(rows).items() for i, _ in found}
    assert len(got & want) >= 0.95 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]),
            (100, [1.0]), (0, [1.0, 0.0]), *[(i, [3.0, 4.0]) for i in range(200, 300)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "2 AS kind", "3 AS size", "4 AS point", "5 AS id")
    got = {}
    for r in nearest(df, df["vec_id"] % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [200, 201, 202, 203, 204], 50: [200, 201, 202, 203, 204], 200: [201, 202, 203, 204, 205], 250: [200, 201, 202, 203, 204]}
    assert nearest(df.limit(0), df["vec_id"] % 50 == 0).count() == 0


def test_fused_evidence(spark):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog went to the house with them", "en"), ("der hund und die katze gehen nach haus mit ihnen", "de"),
                                                                        ("le chat et le chien vont dans la maison avec eux", "fr")] * 20)], "doc_id long, text string, lang string")
    model = L.fit_text_model(docs)
    assert model[0] == ["de", "en", "fr"]
    article = {"en": "the dog and the cat went to the house", "de": "die katze und der hund gehen nach haus", "fr": "le chien et le chat dans la maison"}

    def page(i, host, text, lang):
        return (i, f"https://{host}/x", f'<html{lang and f" lang={chr(34)}{lang}-XX{chr(34)}"}><body><article><p>{text}</p></article></body></html>')

    rows = [page(i, "a.example.de", article["de"], "de") for i in range(20)] + [page(100 + i, "b.example.com", article["en"], "en") for i in range(40)]
    rows += [page(200, "a.example.de", "", "de"), page(201, "b.example.com", "", ""), (202, None, None), page(203, "b.example.com", article["fr"], "fr"), page(204, "c.example.de", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in L.identify(L.page_rows(df, ["page_id"]), model, ["page_id"]).collect()}
    assert len(got) == len(rows) and all(0 < r.confidence <= 1 for r in got.values())
    assert all(got[i].lang == "de" for i in range(20)) and all(got[100 + i].lang == "en" for i in range(40))
    assert [got[i].lang for i in (200, 201, 203, 204)] == ["de", "en", "fr", "de"] and got[202].text_lang is None
    assert L.identify(L.page_rows(df.limit(0), ["page_id"]), model, ["page_id"]).count() == 0
    empty = L.fit_text_model(docs.limit(0))
    assert {r.lang for r in L.identify(L.page_rows(df, ["page_id"]), empty, ["page_id"]).collect()} == {None}


def test_language_query_covers_both_tables(spark, sf):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = {r.page_id: re.search(r'lang="(\w+)', r.html)[1] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op5_language"](spark, sf).collect()
    assert {r.doc_id for r in rows if r.kind == "document"} == docs.keys() and {r.page_id for r in rows if r.kind == "page"} == pages.keys()
    right = [r.lang == (docs[r.doc_id] if r.kind == "document" else pages[r.page_id]) for r in rows]
    assert np.mean(right) > 0.95


def test_blocks_beside_long_paragraphs_without_an_article_element():
    from expirylens.llm.html_extraction import main_text
    long = "A long sentence, with commas, about rivers; it goes on. " * 20
    page = ("<body><nav><p>Home page link</p></nav><div class='content'>" + f"<p>{long}</p>" * 10 + "<ul>" + "".join(f"<li>item{k}</li>" for k in range(8))
            + "</ul><table><tr>" + "".join(f"<td>cell{k}</td>" for k in range(8)) + "</tr></table></div></body>")
    text = main_text(page)[0]
    assert all(f"item{k}" in text and f"cell{k}" in text for k in range(8)) and "Home" not in text
    for shown in ('class="overflow-hidden"', 'style="overflow:hidden"', 'data-hidden="1"'):
        assert "rivers" in main_text(f"<body><div {shown}><p>{long}</p></div></body>")[0]
    for not_shown in ("hidden", 'style="display: none"', "aria-hidden=true", 'hidden=""'):
        assert main_text(f"<body><div {not_shown}><p>{long}</p></div></body>")[0] == ""


@pytest.mark.parametrize("shard", [8192, 12])
def test_equal_scores_go_by_id(spark, shard):
    """Scaled copies of one direction, and mirrored vectors of equal cosine, over one shard and over several."""
    base = np.array([0.3, -0.4, 1.2, 0.5])
    rows = [(i, [float(x) for x in base * 2.0 ** (i % 9 - 4) * (1 if i % 2 else 4)]) for i in range(1, 31)] + [(50, base.tolist())]
    rows += [(100, [1.0, 0.0])] + [(200 + i, [1.0, (-1.0) ** i * (1 + i // 2)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, (df.vec_id % 50 == 0) & (df.vec_id <= 100), shard_vectors=shard).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[50] == [1, 2, 3, 4, 5] and got[100] == [200, 201, 202, 203, 204]
