import html
import re

import pytest
from pyspark.sql import functions as F

from rollcall.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
<header id=top><a href=/>Home</a> Site name</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work better for all of you.</div>
<main><article class="post"><header><h1>The  title &amp; more</h1><p class="byline">By A. Writer</p></header>
<p>First <b>para</b>graph with &eacute;&#233; and <a href=x>a link</a>.<p>Short.</p>
<ul><li>Item one<li>Item two is longer</ul><!-- <p>no</p> --><blockquote>Quoted words</blockquote>
<aside><p>Related: something else to read.</p></aside><pre>code
  here</pre><div class="ad-slot">Buy now the best thing there is today for you</div>
<form><label>Your mail</label><button>Send</button></form>
<section id="comments"><h2>Comments</h2><div><p>I think this is a long comment, really long.</p></div></section>
</article></main><aside class=sidebar><p>Sidebar text that goes on and on for quite a while.</p></aside>
<footer><p>(c) all rights</p></footer><script>var a="<p>x</p>"</script></body></html>"""


def text(page):
    return H.main_text(page, H.learned_tree())


def test_article_without_the_rest():
    assert text(PAGE) == "\n\n".join([
        "The title & more", "First paragraph with éé and a link.", "Short.", "Item one",
        "Item two is longer", "Quoted words", "code here"])


def test_page_without_article_element():
    page = ("<div id=wrap><div class=menu><a href=1>a</a> <a href=2>b</a></div><h1>Big title here</h1>"
            f"<div>{'word ' * 60}</div><div>{'text ' * 40}<br>and more</div><p>Tiny end.</p>"
            "<div id=footer>Imprint and privacy</div></div>")
    assert text(page) == "\n\n".join(["Big title here", ("word " * 60).strip(),
                                      "text " * 40 + "and more", "Tiny end."])


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<script>x</script>", "<!-- open", "<p"])
def test_pages_without_text(page):
    assert text(page) in ("", "<p")


def test_broken_markup_is_read_on():
    body = "Some words that make up a paragraph of a fair length, as one may see in print."
    assert text(f"<article><p><b>{body}<br><p>{body}</article>") == f"{body}\n\n{body}"
    assert text(f"<article><div class=x><p>{body}</span></p></article><p>tail</p>") == body
    assert text(f"<article><p title='>'>{body} 1 < 2</p></article>") == f"{body} 1 < 2"
    assert text(f"<div class=ad>open<article><p>{body}</p></article>") == body


BODY = "Some words that make up a paragraph of a fair length, as one may see in print. " * 2


@pytest.mark.parametrize("page", [
    "<body><div class='has-sidebar'><h1>Title here</h1><p>{0}</p><p>{0}</p></div></body>",
    "<body><div id='page' class='menu-open'><h1>Title here</h1><p>{0}</p><p>{0}</p></div></body>",
    "<body><div data-title='the hidden cost'><h1>Title here</h1><p>{0}</p><p>{0}</p></div></body>",
    "<body><div class='widget'><h1>Title here</h1><p>{0}</p><p>{0}</p></div><div class=footer>Imprint</div></body>",
    "<body><form id=aspnetForm><h1>Title here</h1><p>{0}</p><p>{0}</p></form><div class=menu>x</div></body>",
    "<article><h1>Title here</h1><section aria-label='Hidden gems'><p>{0}</p></section><p>{0}</p></article>",
    "<article><h1>Title here</h1><div data-id='menu'><p>{0}</p></div><p>{0}</p></article>",
    "<article><h1>Title here</h1><p class='related-work'>{0}</p><p>{0}</p></article>"])
def test_names_of_wrappers_drop_no_article(page):
    assert text(page.format(BODY)) == "\n\n".join(["Title here", BODY.strip(), BODY.strip()])


@pytest.mark.parametrize("name", ["site-footer", "cookieNotice", "ad-slot-3", "post-comments", "js-newsletter-box",
                                  "sidebar", "main_nav", "share-buttons left"])
def test_names_of_boilerplate_count(name):
    noise = f"<div class='{name}'><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div>"
    article = f"<article><h1>Title here</h1><p>{BODY}</p></article>"
    assert text(f"<body>{noise}{article}{noise}</body>") == f"Title here\n\n{BODY.strip()}"
    assert text(f"<body>{article.replace('</article>', noise + '</article>')}</body>") == f"Title here\n\n{BODY.strip()}"


def test_links_run_through_blocks():
    blocks = H.page_blocks("<div><a href=x><div>one two</div><p>three</p></a><p>four</p></div>"
                           "<ul><li><a href=y>five<li>six</ul><p><a href=z>seven<p>eight")
    assert [(b.text, b.link_words) for b in blocks] == [
        ("one two", 2), ("three", 1), ("four", 0), ("five", 1), ("six", 0), ("seven", 1), ("eight", 0)]


def test_time_is_linear():
    import time
    start = time.process_time()
    for page in ('<p "' * 50000, '<a href="x' * 50000, "<!-- " * 50000, "<div>" * 20000 + "x",
                 "</div>" * 50000, "<script " * 50000, "&amp" * 50000, "<!x" * 200000, "<!x" * 200000 + ">",
                 "<svg>" * 50000, "<title>" * 50000 + "-->", "<header>" * 50000, "<div class=ad>" * 50000 + "x"):
        text(page)
    assert time.process_time() - start < 30


def test_unclosed_elements_are_linear():
    import time
    start = time.process_time()
    H.page_blocks("<div>" * 64000 + "</p>" * 64000)
    H.page_blocks("<div><a>" * 64000 + "</p></li>" * 64000)
    assert time.process_time() - start < 2


def test_the_tree_fits_its_table():
    import numpy as np
    rows = np.array([[float(v) for v in x.split()] for x in H.LABELLED.strip().splitlines()])
    assert (H.learned_tree().predict(rows[:, :-1]) == rows[:, -1]).all()


def test_query_frame(spark):
    rows = [(1, "u", PAGE, "x"), (2, "v", None, "y"), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("_html", F.lit(1))
    got = sorted(H.extract_text(df).collect(), key=lambda r: -r.n_chars)
    assert [(r.page_id, r.n_chars, len(r.text)) for r in got] == [
        (1, got[0].n_chars, got[0].n_chars), (2, 0, 0), (2, 0, 0)]
    assert got[0].n_chars > 80 and H.extract_text(df.limit(0)).count() == 0


def test_driver_pages(spark):
    """Every block of the article element, and nothing outside it."""

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)

        parts = re.sub(r"</?(p|h1)>", "\0", inner)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split())
                 for p in parts.replace("<br>", " ").split("\0")]
        assert text(r.html) == "\n\n".join(p for p in parts if p)
