from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest
from hostlake.llm import blocks
from hostlake.llm.htmlblocks import leaves
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def model():
    return blocks.trained()


def texts(page):
    return [t for _, t, _ in leaves(page)]


def test_blocks_of_broken_markup():
    assert texts("<p>a <b>b\n c<p>d&amp;e&nbsp;&#x41;<br>f</i></p>g<!-- <p>x</p> -->h") == ["a b c", "d&e A f", "gh"]
    assert texts("<script>if (a<b) '<p>no</p>'</script><style>p{}</style><title>t</title><p>x</p>") == ["x"]
    assert texts("a < b <p title='>'>c</p> <div class=\"x>y\">d</div") == ["a < b", "c", "d"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == list("abcdef")
    assert texts("") == texts("<p> \n </p>") == []
    paths = [[n for n, _ in p] for p, _, _ in leaves("<div><ul><li>a<li>b</ul></span></div></div><p>c<div>d</div>e")]
    assert paths == [["div", "ul", "li"], ["div", "ul", "li"], ["p"], ["div"], []]
    assert [m for p, _, _ in leaves('<div class="sideBar left-col" id=Top style="display: none">x</div>') for _, m in p] == [("side", "bar", "left", "col", "top", "hidden")]
    assert [n for _, _, n in leaves("<p>ab <a href=x>link</a> c</p>")] == [4]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = blocks.Labeller.fresh(3, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    size = blocks.PATHS + blocks.WORDS + blocks.MEASURES
    x = rng.standard_normal((5, 3, size)) * 0.1
    there = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    y = rng.integers(0, 2, (5, 3)).astype(float)
    _, grads = net.gradients(x, there, y)
    for name in net.p:
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        old = net.p[name][at]
        ends = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            ends.append(net.gradients(x, there, y)[0])
        net.p[name][at] = old
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(float(grads[name][at]), abs=2e-4)


def test_scores_do_not_depend_on_company(model):
    pages = [b for b, _ in blocks.invented(77, 40)]
    together = blocks.labelled(model, pages)
    for page, scores in zip(pages, together, strict=True):
        assert np.allclose(model.scores([page])[0], scores, atol=1e-4)
        x, there = blocks.inputs([page])
        states = model.states(x, there)
        assert np.allclose(1 / (1 + np.exp(-(states @ model.p["v"])[:, 0, 0] - model.p["e"])), scores, atol=1e-4)


def test_pages_in_slices(model, monkeypatch):
    page = [b for bl, _ in blocks.invented(78, 30) for b in bl]
    want = model.scores([page])[0]
    monkeypatch.setattr(blocks, "STEPS", 7)
    assert np.allclose(model.scores([page])[0], want, atol=1e-4)


def test_held_out_templates(model):
    """Pages from another seed."""
    test = blocks.invented(999, 300)
    scores = blocks.labelled(model, [b for b, _ in test])
    right = np.concatenate([(s >= 0.5) == (y > 0.5) for s, (_, y) in zip(scores, test, strict=True)])
    assert right.mean() > 0.99


PLANTED = """<html><head><title>T</title></head><body><div id="cookie-bar" class="cookie-notice"><p>We use cookies to improve your experience.</p><button>Accept</button></div>
<header class="site-header"><a href="/">The Daily</a><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav></header>
<div class="wrapper"><div class="post-content"><h1>A river &amp; its towns</h1><p>The river rises in the hills, and for most of its
 way it is&nbsp;narrow. Towns came late.</p><div class="ad-slot">Buy one now, get one free!</div><p>Two mills stood there, until the flood of that year took both of them away.</p>
<ul><li>the upper mill, built of stone</li><li>the lower mill, built of wood</li></ul><blockquote>Nobody had seen such water before.</blockquote><p>They were not rebuilt.</p></div>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten ways to cook rice</a></li><li><a href="/2">Weather</a></li></ul></aside></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I grew up there and remember the lower mill well.</p></div><div class="comment"><p>Great read, thanks!</p></div>
<form><label>Your comment</label><textarea></textarea><button>Send</button></form></section>
<footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer><script>track("<p>x</p>")</script></body></html>"""
ARTICLE = "\n\n".join(["A river & its towns", "The river rises in the hills, and for most of its way it is narrow. Towns came late.", "Two mills stood there, until the flood of that year took both of them away.", "the upper mill, built of stone", "the lower mill, built of wood", "Nobody had seen such water before.", "They were not rebuilt."])


def test_planted_page_and_edges(spark, model):
    rows = [(1, "u", PLANTED), (1, "u", PLANTED), (2, None, None), (3, "v", ""), (None, "w", "<nav><a href=/x>Home</a></nav>"), (5, "x", "<article>" + "<p>A long tale of many words, told again and again.</p>" * 9000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "__html", "n_chars", "n_blocks", "path")})
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in blocks.extracted(df, model).collect()), key=str)
    assert got[:4] == [(0, "w", "", 0), (1, "u", ARTICLE, len(ARTICLE)), (1, "u", ARTICLE, len(ARTICLE)), (2, "", "", 0)]
    assert got[4] == (3, "v", "", 0) and got[5][3] == 9000 * 50 - 2
    assert blocks.extracted(df.limit(0), model).collect() == []


def test_whole_table(spark, sf):
    """The table's articles are in an article element; a slow reading of that element agrees for nearly all blocks."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in blocks.op13_blocks(spark, sf).collect()}
    assert got.keys() == pages.keys()
    same = wanted = found = 0
    for i, page in pages.items():
        inner = page[page.index("<article>") : page.index("</article>")]
        parts = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?(b|i|article)>", "", t))).split()) for t in re.split("</?(?:p|h1)>", inner)]
        want, have = [p for p in parts if p], got[i].split("\n\n") if got[i] else []
        same += len(set(want) & set(have))
        wanted, found = wanted + len(set(want)), found + len(set(have))
    assert same / wanted > 0.99 and same / found > 0.995
