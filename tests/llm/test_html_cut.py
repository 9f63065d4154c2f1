import html
import itertools
import random
import re
import time

import pytest

from marketloom.llm import html_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>Welcome to our great site, with a long enough tagline for all of us.</p></header>
<div id="cookie-notice"><p>We use cookies to give you the best experience on this site. By going on you agree.</p></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=x>One thing</a><li><a href=y>Other thing</a></ul></div>
<{box}><h1>Title here</h1><p>First paragraph of the story, which is long enough to be found as such by anyone.</p><p>Short.</p>
<div class="ad-slot">Buy now!</div><p>Second one &amp; last&nbsp;one,<br>with a   break
and <a href=z>a link</a>&#33; <!-- gone --><script>if (a<b) "</p>"</script></p></{end}>
<form><label>Name</label><input><p>Please send us your name and address in this form, thank you very much.</p></form>
<section id="comments"><article class="comment"><p>I think this is a really great article, thanks for writing it so well.</p></article></section>
<footer><p>Copyright 2024 by the company that made this page and all the others.</p></footer>"""
TEXT = "Title here\n\nFirst paragraph of the story, which is long enough to be found as such by anyone.\n\nShort.\n\nSecond one & last one, with a break and a link!"


@pytest.mark.parametrize("box,end", [("article", "article"), ("main", "main"), ('div class="content"', "div"), ("div", "div")])
def test_article_without_the_rest(box, end):
    assert html_cut.main_text(PAGE.replace("{box}", box).replace("{end}", end)) == TEXT


def test_a_short_block_follows_its_neighbours():
    page = "<div>" + "<p>A long paragraph of the story, with more than enough words to be told from a menu.</p>" * 3 + "<div><span>ok</span></div>" * 1
    found = html_cut.blocks(page + "<p>And another long paragraph of the same story, which ends it for good.</p></div>")
    costs = [html_cut.cost(t, b) for t, b in found]
    assert costs[3] < 0 and all(html_cut.minimum_cut(costs, html_cut.edges([b for _, b in found])))


def test_cut_is_the_least_of_all_labellings():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 8)
        costs = [r.uniform(-5, 5) for _ in range(n)]
        links = [(i, j, r.uniform(0, 4)) for i in range(n) for j in range(i) if r.random() < 0.4]
        price = lambda x: sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, x)) + sum(w for i, j, w in links if x[i] != x[j])  # noqa: B023, E731
        assert price(html_cut.minimum_cut(costs, links)) == pytest.approx(min(map(price, itertools.product([False, True], repeat=n))))


def test_given_pages_give_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, source in zip(html_cut.extract(rows).orderBy("page_id").collect(), rows.orderBy("page_id").collect()):
        body = re.search(r"<article>(.*)</article>", source.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == source.url


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!-- never closed <p>x</p>", "<script>x", "</p></div>", "<p>&#x110000;&bogus;</p>", "\x00"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(html_cut.main_text(page), str)


@pytest.mark.parametrize("page", ["<div>" * 30000 + "<p>abc def.</p>" * 10000, "<p>" + "a < b " * 50000, "<a href='" + 'x" ' * 30000, "<b>" * 20000 + "<p>x</p>" * 5000, "<p>some words here.</p>" * 20000])
def test_long_and_odd_pages_take_linear_time(page):
    start = time.process_time()
    html_cut.main_text(page)
    assert time.process_time() - start < 10


def test_null_repeated_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article><p>Some text here.</p></article>", "x"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    got = html_cut.extract(df)
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, "Some text here."), (1, ""), (1, "")]
    assert html_cut.extract(df.limit(0)).count() == 0


LONG = "<p>A long paragraph of the story, with more than enough words to be told from a menu.</p>"


@pytest.mark.parametrize("value", ["<b>x</b> ", " > ", "'quoted' < "])
@pytest.mark.parametrize("size", [10, 5000, 200000])
def test_attribute_values_of_any_length(value, size):
    props = value * (size // len(value))
    page = f'<article>{LONG}<div class="advert" data-props="{props}">Buy this now, it is cheap.</div><p>The story ends here.</p></article>'
    assert html_cut.main_text(page) == html_cut.main_text(f"<article>{LONG}<p>The story ends here.</p></article>")


def test_marks_are_weights_of_the_cut():
    text = html_cut.main_text(f"<article>{LONG}</article>")
    assert html_cut.main_text(f'<main><div class="search-results content">{LONG}</div></main>') == text
    assert html_cut.main_text(f'<article>{LONG}</article><div class="user-responses"><p>I liked this story a lot, thank you for it.</p></div>') == text
    assert html_cut.main_text(f'<article>{LONG}<div class="legal">All rights in this text are reserved by us.</div></article>') == text


def test_a_stray_quote_ends_at_its_tag():
    assert html_cut.main_text('<article><p title="x>One two three.</p><p>Four five six.</p></article>') == "One two three.\n\nFour five six."
    assert html_cut.main_text("<article><p>It is 1 < 2 and a<b here.</p></article>") == "It is 1 < 2 and a<b here."
