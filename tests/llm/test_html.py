"""HTML extraction: exact text of the given pages, held-out composed layouts, and odd markup."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"
PROSE = "The committee met in the morning and heard the report of the chair. Several members asked for more time, and a second reading was set for the following week."


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.fit(spark.read.parquet(PAGES))


def article(page: str) -> str:
    inner = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
    blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def test_every_given_page_gives_its_article(spark, trees):
    rows = spark.read.parquet(PAGES).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(rows, trees).collect()}
    want = {r.page_id: article(r.html) for r in rows.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_held_out_layouts(trees):
    rng, right, n = random.Random(4711), 0, 300
    texts = [PROSE, PROSE[60:] + " " + PROSE[:50] + ".", "A short remark. Then a long one, which says nothing new but says it at length, as is the custom here."]
    for _ in range(n):
        page = html_text.composed(texts, rng)
        parsed = html_text.Page(page)
        want = html_text.main_text(parsed, np.array(html_text.marks(parsed)) == 1)
        right += html_text.texts_of([re.sub(" data-y=[01]", "", page)], trees)[0] == want
    assert right / n >= 0.85


def test_a_page_with_everything_around_the_article(trees):
    links = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(6))
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>document.write("<p>no</p>")</script></head><body>
    <div class="cookie-banner"><p>We use cookies to give you a better visit. Accept them all or choose.</p><button>OK</button></div>
    <header><div class="logo">The Paper</div></header><nav><ul>{links}</ul></nav>
    <div id="sidebar"><h3>More</h3><ul>{links}</ul></div>
    <div class="post-content"><h1>A &quot;title&quot; &amp; more</h1><p>{PROSE}<p>Second&nbsp;<b>bold</b>
      line. {PROSE}</p><div class="advert">Buy this now, only today.</div><p>{PROSE} <a href="/x">A link</a> in it.</p></div>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>{PROSE}</p></div><div class="comment"><p>I agree with this.</p></div></section>
    <form action="/s"><label>Search</label><input name="q"></form><footer>&copy; 2020 The Paper</footer></body></html>"""
    assert html_text.texts_of([page], trees)[0] == f'A "title" & more\n{PROSE}\nSecond bold line. {PROSE}\n{PROSE} A link in it.'


def test_decoding_never_goes_in_twice_on_a_path(trees):
    rng = np.random.default_rng(2)
    for _ in range(50):
        page = html_text.Page("<div>" * 3 + "".join(rng.choice(["<div>x", "</div>", "<p>y"]) for _ in range(60)))
        inside = html_text.decode(page, rng.normal(size=len(page.tag)) * 3)
        for v in range(1, len(page.tag)):
            path, u = [], v
            while u >= 0:
                path.append(bool(inside[u]))
                u = page.parent[u]
            assert sum(a != b for a, b in zip(path, path[1:])) <= 2 and not path[-1]


def test_odd_markup_and_empty_tables(spark, trees):
    odd = [None, "", "plain", "<", "<<<>", "<a", '<p class="', "</div></p>", "<!-- open", "<script>", "<p>" * 5000 + "x", "<div>" * 20000 + "deep", '<a "' * 20000, "&#0;&#x110000;&bogus;", "<p>é😀</p>" * 3, "<select><option>x" * 50]
    out = html_text.texts_of(odd, trees)
    assert len(out) == len(odd) and all(isinstance(t, str) for t in out)
    schema = "page_id long, url string, html string"
    rows = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], schema)
    assert [tuple(r) for r in html_text.extract(rows, trees).collect()] == [(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0)]
    assert html_text.extract(rows.limit(0), trees).collect() == []
    page = html_text.Page('<p>1 &lt; 2 < 3<div class=ad>x</div><td "<p>')
    assert html_text.main_text(page, np.ones(len(page.tag), bool)) == '1 < 2 < 3\nx'
