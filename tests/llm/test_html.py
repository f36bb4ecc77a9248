"""Main text of small pages."""

import time

import pytest

from newsgraph.llm import html

LONG = "A sentence, with commas, that is long enough to score as a paragraph of the article, and more."
CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    ("just text &amp; more", "just text & more"),
    (f"<nav><a href=/>Home</a></nav><article><h1>T&eacute;st</h1><p>{LONG}<p>Short.<br>line</article><footer>foot {LONG}</footer>", f"Tést\n\n{LONG}\n\nShort. line"),
    (f"<div id=sidebar><p>{LONG}{LONG}</div><div class=content><p>{LONG}</p><p>ok</p></div>", f"{LONG}\n\nok"),
    (f"<main><p>{LONG}</p><div class='ad-slot'><p>{LONG}</p></div><section class='comments'><p>{LONG}</p></section><form><p>{LONG}</p></form></main>", LONG),
    (f"<script>var a = '<p>{LONG}</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>{LONG}</p> -->", LONG),
    (f"<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><ul><li>kept</li></ul></article>", f"{LONG}\n\nkept"),
    (f"<article><p><b>Bold {LONG}<br><p>next\n\t  &nbsp;one</p></b></article>", f"Bold {LONG}\n\nnext one"),
    (f"<p>{LONG}</p><p>x", f"{LONG}\n\nx"),
    (f"<table><tr><td>{LONG}<td>b<tr><td>c</table>", f"{LONG}\n\nb\n\nc"),
    (f"<div style='display:none'>{LONG}</div><div role=navigation>{LONG}</div><div><p>{LONG}</p></div>", LONG),
    (f'<div title="a > b" data-x=\'<p>\'><p>{LONG}</p></div>', LONG),
    ("<p>a &lt; b &#65;&#x42; &amp;amp; &unknown; &am", "a < b AB &amp; &unknown; &am"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_odd_and_long_pages():
    assert html.main_text("<div>" * 3000 + LONG) == LONG
    assert html.main_text("<" * 5000) == "<" * 5000
    assert html.main_text("<p class=\"never closed" + "x" * 50_000) != "never"
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert html.main_text(f"<article>{many}</article>").count("\n\n") == 4999


def test_extract(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "old"), (1, "u", f"<p>{LONG}</p>", "old"), (None, None, None, "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages, ["page_id", "url", "text"]).collect()
    assert [r.text for r in got] == [LONG, LONG, ""] and got[0].asDict().keys() == {"page_id", "url", "text"}
    assert html.extract(pages.limit(0), ["page_id"]).count() == 0


STORY = "<p>" + "A long paragraph, with commas, that says quite a lot about the story of the day. " * 3 + "</p>"


@pytest.mark.parametrize("page", [
    "<article class='post has-ads'>%s</article>", "<div id=page class='site no-sidebar'><article>%s</article></div>", "<div class='content with-comments'>%s</div>",
    "<main class='notice'>%s</main>", "<div class='hidden'>%s</div>",
    "<div id=comments><article class='comment-body'><p>me too, me too, says a reader at some length here</p></article></div><div>%s</div>",
    "<article class='news'>%s</article><div id=comments><article class='media'><p>me too, me too, says a reader at some length here</p></article></div>"])
def test_a_class_does_not_take_out_the_article(page):
    text = html.main_text("<html><body><nav><a href=x>menu</a></nav>" + page % STORY + "<div class=ads>Buy this, now, and that</div></body></html>")
    assert text.startswith("A long paragraph") and text.endswith("day.") and "me too" not in text and "Buy" not in text


def test_large_pages_take_linear_time():
    n = 100_000
    for page in ("<span>" * n + "</b>" * n, "<a '" * n, "<div>" * n + "x", "<span>x" * n, "<div><a href=q>link</a>" * (n // 5)):
        start = time.process_time()
        html.main_text(page)
        assert time.process_time() - start < 4
