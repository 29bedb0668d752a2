"""Main text on hand-labelled pages, on odd ones, and against an independent reading of the given pages."""

from __future__ import annotations

import re
import time
from collections import Counter
from html import unescape

import pytest

from pathloom.llm import html

PROSE = "The keeper of the lighthouse had been on the rock for a year, and the sea was all that he saw from the window in the evening. He wrote to the harbour that the lamp was in need of oil, and that the boat should come before the winter was upon them all."
RUSSIAN = "Смотритель маяка прожил на скале целый год, и вечером из окна он видел одно только море. Он написал в гавань, что для лампы нужно масло и что лодка должна прийти раньше зимы, пока лёд не закрыл путь к берегу."
CHINESE = "灯塔的看守人在礁石上住了整整一年，傍晚从窗口望出去，只能看见一片大海。他写信给港口，说灯需要油，船应当在冬天到来之前开来，否则冰会封住通往岸边的路，所有人都要等到春天才能离开这里回到家中。"
POLISH = "Latarnik mieszkał na skale przez cały rok, a wieczorem z okna widział tylko morze. Napisał do portu, że lampa potrzebuje oliwy i że łódź powinna przypłynąć przed zimą, zanim lód zamknie drogę do brzegu i wszyscy będą musieli czekać."


@pytest.mark.parametrize(
    "opening",
    ['<div style="overflow: hidden">', '<div data-hidden="false">', '<div data-id="related">', '<div title="the hidden valley">', '<div class="layout has-sidebar">', '<div class="no-comments">', "<svg class=x />", "<button>", "<select>", "<title>", "<textarea>", '<div alt="nav">', "<p>"],
)
def test_ordinary_pages_keep_their_text(opening):
    assert PROSE in html.main_text(f"<html><body>{opening}<div><p>{PROSE}</p></div></body></html>")


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, POLISH])
def test_any_language(text):
    page = f'<body><div class="nav"><a href=/>{text[:20]}</a></div><div><p>{text}</p><p>{text}</p></div><div id="footer">{text}</div></body>'
    assert html.main_text(page) == f"{text}\n{text}"


@pytest.mark.parametrize("mark", ['class="advert"', "class='share'", "hidden", 'aria-hidden="true"', 'role="navigation"', "id=promo", 'style="display: none"'])
def test_marked_text_inside_a_paragraph_goes(mark):
    assert html.main_text(f"<p>{PROSE} <span {mark}>BUY <b>NOW</b></span>{PROSE}</p>") == f"{PROSE} {PROSE}"


def test_unclosed_and_self_closing_elements():
    assert html.main_text(f"<article><p>{PROSE}</p><svg><path/></svg><p><button>Send<p>{PROSE}</p></article>").endswith(PROSE)
    assert html.main_text(f"<p>{PROSE}</p><script>var a = 1;") == PROSE


@pytest.mark.parametrize("page", ["<a>" * 20000, "</x>" * 20000 + "<div>" * 20000 + "</x>" * 20000, "<title>" * 20000, "<p><b>" * 20000 + "</i>" * 20000, "<button>" * 20000])
def test_time_is_in_proportion(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 2


#: Pages and the blocks that a reader marks as the article.
PAGES = {
    "blog": (f"<header><h1>My site</h1><a href=/>home</a></header><div id=content><h2>A title</h2><p>{PROSE}</p><p>It was late.</p><p>{PROSE}</p></div><div class=comments><p>{PROSE}</p></div><footer>All rights reserved by the owner of the site</footer>", ["A title", PROSE, "It was late.", PROSE]),
    "news": (f"<nav><a href=1>World</a><a href=2>Sport</a></nav><main><article><h1>News &amp; more</h1><p>{PROSE}</p><ul><li>one thing</li><li>another</li></ul><blockquote>{PROSE}</blockquote></article><aside><p>{PROSE}</p></aside></main>", ["News & more", PROSE, "one thing", "another", PROSE]),
    "list": (f'<div class="wrapper with-sidebar"><div class=sidebar><ul>{"".join(f"<li><a href={i}>Link {i} of the side</a></li>" for i in range(20))}</ul></div><div class=post><p>{PROSE}</p><p>{PROSE}</p></div></div>', [PROSE, PROSE]),
    "forum": (f"<table><tr><td><p>{PROSE}</p></td><td><a href=x>reply to the writer of this</a></td></tr></table><form><p>{PROSE}</p></form>", [PROSE]),
    "nothing": ("<nav><a href=/>Home</a></nav><div class=cookie-notice>We use cookies on the site and you agree to all of them by the use of it.</div>", []),
}


def test_labelled_pages():
    right = found = wanted = 0
    for page, want in PAGES.values():
        got, want = Counter(html.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>").split()), Counter(" ".join(want).split())
        right, found, wanted = right + sum((got & want).values()), found + sum(got.values()), wanted + sum(want.values())
    assert 2 * right / (found + wanted) > 0.97


def test_op4_equals_the_articles_of_the_given_pages(spark, sf_dir):
    """The given pages have one article each; its blocks are read here with plain patterns."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html.op4(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html or "", re.S)
        inner = re.sub(r"<br[^>]*>", " ", re.sub(r"<!--.*?-->", "", article[1], flags=re.S)) if article else ""
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d|ul|li|div)\b[^>]*>", inner))
        want = "\n".join(filter(None, parts))
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_clashing_columns_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{PROSE}</p>", "x"), (1, "u", f"<p>{PROSE}</p>", "x"), (None, None, None, None), (2, "", "", "")], "page_id long, url string, html string, text string").withColumns({"n_chars": html.F.lit(5), "label": html.F.lit(1)})
    got = html.extract_main_text(rows).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [(0, "", ""), (1, "u", PROSE), (1, "u", PROSE), (2, "", "")]
