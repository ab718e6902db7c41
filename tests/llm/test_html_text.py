"""Main text: what belongs to an article and what does not."""

import html as entities
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dqspark.llm import html_text

PROSE = ("The man and the dog were in the house of the king and it was that which they had not seen when "
         "all of them came to the town for one day in the year with some of their friends and more.")


@pytest.mark.parametrize("page", [
    f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article><footer>© x</footer>",
    f"<header>Site <a href=/>x</a></header><div id=main><h2>Title</h2><p>{PROSE}<p>Short.</div>"
    f"<div class='comment-list'><p>{PROSE}</p></div><div id=cookie-notice>{PROSE}</div>",
    f"<body class=has-sidebar><main><h1>Title</h1><div>{PROSE}</div><div>Short.</div></main>"
    f"<aside>{PROSE}</aside><form>{PROSE}<input></form>",
    f"<div class=ad>{PROSE}</div><article><h1>Title</h1><p><b>{PROSE}<br><p>Short.<div class='ad-slot'>Buy</div>"
    f"<ul><li><a href=a>Read</a></li></ul></article>",
    f"<script>var a='<p>{PROSE}</p>';</script><style>p{{}}</style><article><!-- <p>x</p> --><h1>Title</h1>"
    f"<p>{PROSE}</p><p>Short.",
])
def test_articles(page):
    assert html_text.main_text(page) == f"Title\n\n{PROSE}\n\nShort."


CARD = "<article class={}><h3><a href=a>Ten towns</a></h3><p>A short teaser.</p></article>"
LINKED = "<p><a href=a>See what this offer has for you and for all of your friends</a> now</p>"


@pytest.mark.parametrize("page", [
    f"<div><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><hr>" + CARD.format("card") * 3,
    f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></article>" + CARD.format("card") * 3,
    f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></article>"
    f"<article class=related-post><p>{PROSE}</p></article>",
    f"<article class='post category-social'><h1>Title</h1>{LINKED}<p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>{LINKED}"
    "</article>",
])
def test_an_article_element_is_evidence_only(page):
    text = html_text.main_text(page)
    assert f"Title\n\n{PROSE}\n\nShort.\n\n{PROSE}" == text, text


def test_articles_without_stop_words_stay_whole():
    text = "Zamek królewski stoi nad rzeką, dokąd przyjeżdżają turyści oglądać stare mury oraz ogrody pełne kwiatów."
    page = f"<div>{text[:60]}</div><article><h1>Zamek</h1><p>{text}</p><p>{text}</p></article>" + CARD.format("x")
    assert html_text.main_text(page) == f"Zamek\n\n{text}\n\n{text}"


POLISH = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
          "sumieniem i powinni postępować wobec innych w duchu braterstwa.")
JAPANESE = "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。" * 5


@pytest.mark.parametrize("text", [f"{POLISH}\n\n{POLISH}", JAPANESE])
def test_pages_in_a_language_of_no_list(text):
    body = "".join(f"<p>{x}</p>" for x in text.split("\n\n"))
    page = f"<nav><a href=/>Menu</a></nav><div>{body}</div><ul><li><a href=a>{POLISH}</a></li></ul><footer>x</footer>"
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", [
    f'<div class="notice-board"><article><p>{PROSE}</p></article></div>',
    f'<div id="ad-free-reading"><p>{PROSE}</p></div><div class="ad">Buy this now and save</div>',
    f'<div class="social-page"><div><p>{PROSE}</p></div></div><div class="share">Share this with all of your friends</div>'])
def test_names_around_the_article(page):
    assert html_text.main_text(page) == PROSE


@pytest.mark.parametrize("page", [
    f'<div><p>{PROSE}</p></div><div class="comments"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>',
    f'<article><p>{PROSE}</p></article><div class="ad"><p>{PROSE}</p><p>{PROSE}</p></div>',
    f'<div><p>{PROSE}</p><p>{PROSE[:0]}</p></div><div class="related"><p>{PROSE}</p></div>'])
def test_names_of_long_parts_beside_the_article(page):
    assert html_text.main_text(page) == PROSE


def test_pages_of_the_best_fitting_list():
    found = html_text.blocks(f"<p>{PROSE}</p>")
    assert html_text.page_stops(found) == html_text.STOP_WORDS["en"]
    assert html_text.page_stops(html_text.blocks(f"<p>{POLISH}</p>")) == frozenset()


def test_white_space_and_references():
    page = "<article><p>\n a&nbsp;&amp;&#x20AC; <i>b</i>c<br>d\t&lt;p&gt; </p>\n<p> </p></article>"
    assert html_text.main_text(page) == "a &€ bc d <p>"


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<a href='", "</p></p>", "<script>x", "<!-- x",
                                  "<nav><a href=/>Home</a></nav>", "<div class=ad>x</div>"])
def test_pages_without_an_article(page):
    assert html_text.main_text(page) in ("", page.strip())[:1] or page.strip() in ("<", "<p", "<a href='")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"<>/pa b!-&;\"'=\n", "<p>", "</div>", "<nav>", "<script>"]), max_size=60))
def test_any_markup_is_read(page):
    text = html_text.main_text("".join(page))
    assert text == text.strip()


def test_pages_against_the_plain_content_of_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        inner = source[r.page_id].partition("<article>")[2].partition("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", inner)
        plain = [" ".join(entities.unescape(re.sub("<[^>]*>", lambda m: " " * (m[0] == "<br>"), p)).split()) for p in parts]
        assert r.text == "\n\n".join(filter(None, plain)) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (3, "u", f"<article>{PROSE * 2000}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select(
        "*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"))
    got = sorted(((r.page_id, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (3, len(PROSE * 2000))], key=str)
    assert html_text.extract(df.limit(0)).collect() == []
