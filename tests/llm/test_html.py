import html
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimflow.llm.html_text import extract_pages, main_text, regions
from tests.conftest import SF_SMALL


def article(page):
    """The blocks of the given pages' article, cut by their fixed layout."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages_equal_their_article(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in entry.queries()["op5_html_extraction"](spark, SF_SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, article(p.html), len(article(p.html)))


FULL = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style></head><body class="with-sidebar">
<div id="cookie-notice"><p>We use cookies and this notice is long enough to look like an article, really quite long.</p></div>
<header><h1>My site</h1><form><p>Search</p><select><option>a<option>b</select></form></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
%s
<aside><p>Sidebar text that goes on for a while and a while, and then some more of it.</p></aside>
<div class="comments"><h3>Comments</h3><p>A reader's comment that is much longer than any paragraph of the article, by far and away.</p></div>
<script>if (a < b) document.write("<p>no</p>");</script>
<footer><p>&copy; me</p></footer></body></html>"""
BODY = """<h2>Title &amp; more</h2>
<p>First   paragraph with <a href="#">a link</a>,
a <b>bold</b>&nbsp;word.</p><p>Of.</p>
<div class="ad"><p>Buy this now, it is the best thing you will ever have bought in your life.</p></div>
<p>Second<br>paragraph &lt;here&gt; <p>Third &eacute;
<ul><li>one item</li><li>another item</li></ul><ul><li><a href="/x">Read X</a></li><li><a href="/y">Read Y</a></li></ul>
<div><p>Last, in a box.</p></div>"""
WANT = """Title & more
First paragraph with a link, a bold word.
Of.
Second
paragraph <here>
Third é
one item
another item
Last, in a box."""


def test_page_parts_are_removed():
    for tag in ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div role="main">%s</div>', "%s"):
        assert main_text(FULL % tag % BODY) == WANT, tag


LONG = "A long paragraph that holds nearly all of the text of this page. " * 12


def test_the_whole_article_is_kept():
    long = LONG.strip()
    for tag in ("<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "%s"):
        page = lambda inner: f"<body>{tag % inner}<footer>me</footer></body>"
        assert main_text(page(f'<h1>Title</h1><div class="body">{long}</div><p>closing</p>')) == f"Title\n{long}\nclosing"
        for box in ("<ul><li>%s</li></ul>", "<ol><li>%s</ol>", "<table><tr><td>%s</table>", "<dl><dd>%s</dl>", "<section>%s</section>"):
            assert main_text(page(f"<p>before</p>{box % long}<section><p>short</p></section><p>after</p>")) == (
                f"before\n{long}\nshort\nafter"), (tag, box)
        if tag != "%s":
            assert main_text(page(f"<div>{long}</div><aside>advert</aside><div>part 2</div>")) == f"{long}\npart 2", tag
    # A marked element is whole whatever divides it; cards beside main are not in it.
    assert main_text(f"<main><p>a</p><nav>x</nav><div>{long}</div><nav>x</nav><p>b</p></main><article>card</article>") == f"a\n{long}\nb"
    assert main_text("<div><article>one</article><aside>ad</aside><article>two</article></div>") == "one\ntwo"


def test_a_word_of_a_class_does_not_remove_the_article():
    long = LONG.strip()
    for open_tag in ('<article class="post category-social tag-privacy">', '<div class="content has-sidebar">', '<div id="page-with-ads">',
                     '<section class="legal">', '<article class="social">', '<div class="widget"><article>', '<div class="ad"><div id="modal">',
                     '<div class="promo"><section class="x" id="legal">', '<div class="comments">'):
        page = f'<body>{open_tag}<h1>Title</h1><p>{long}</p><div class="ad-box x"><p>buy</p></div><p>end</p></body>'
        assert main_text(page) == f"Title\n{long}\nend", open_tag
    # A short article in a named wrapper, a long discussion beside or in it, cards in a named box.
    page = '<div class="social"><article><p>short</p></article></div><div class="%s"><article>{}</article></div>'.format(long)
    assert main_text(page % "comments") == "short"
    for tag in ("main", "div"):
        assert main_text(f'<{tag}><p>The article.</p><div class="comments"><p>{long}</p></div></{tag}>') == "The article."
        assert main_text(f'<{tag}><article><p>The article.</p></article><div class="related"><p>{long}</p></div></{tag}>') == "The article."
    page = f'<main><p>{long}</p><div class="social"><article><p>short</p></article></div></main>'
    assert main_text(page) == f"{long}\nshort"
    assert main_text(f'<article>{long}</article><div class="related"><article>card</article></div>') == long
    for name in ('class="ad"', 'class="adBox"', 'id="cookie-notice"', 'role="complementary"', 'class="x sidebar"'):
        assert main_text(f"<div><p>{long}</p><div {name}><p>not this</p></div><p>end</p></div>") == f"{long}\nend", name
    assert main_text('<div class="ad"><p>x' * 20_000).count("x") == 10_000  # those with most of the text


def test_broken_markup():
    assert main_text("<article><p>one<p>two <b>three</article>") == "one\ntwo three"
    assert main_text("<p>a < b & c &amp; d &#233; &bogus; <!-- no --> e</p>") == "a < b & c & d é &bogus; e"
    assert main_text("plain text") == "plain text"
    assert main_text("<article></article><div><p>outside</p></div>") in ("", "outside")
    assert main_text("<article><p hidden>no</p><p>yes</p></article>") == "yes"
    assert main_text("<div " * 3000).startswith("<div")  # a tag that never ends is text
    assert main_text("</p>" * 20_000 + "<div><p>x</i>" * 20_000).count("x") == 20_000
    assert main_text("<div><p>x" * 20_000).count("x") == 20_000


def test_regions():
    assert regions([5, 0, 5, 0, 0, 0, 9], [0] * 7) == [(0, 3), (4, 7)]
    assert regions([], []) == []
    assert regions([0, 0], [0, 0]) == []
    assert regions([4, 4], [0, 3]) == [(0, 1), (1, 2)]


def test_hard_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>only"), (None, "v", "<article>x</article>"),
            (5, "w", "<article>" + "<p>word word</p>" * 30_000 + "</article>"), (5, "w", "<article>again</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((str(r.page_id), str(r.url), r.n_chars) for r in extract_pages(pages).collect())
    assert got == [("1", "u", 0), ("2", "u", 0), ("3", "None", 4), ("5", "w", 5), ("5", "w", 30_000 * 10 - 1), ("None", "v", 1)]
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html, want", [
    ('<article><h2 id="related-work">Related work</h2><p>Long text.</p><h2 id="search-algorithms">Search</h2><p>More text.</p></article>',
     "Related work\nLong text.\nSearch\nMore text."),
    ('<main><p>Opening of the text.</p><section id="social-impact"><p>Impact.</p></section><section id="privacy"><p>Law.</p></section></main>',
     "Opening of the text.\nImpact.\nLaw."),
    ('<article><div class="legal-framework"><p>The framework.</p></div><p>And the rest of the long article.</p></article>',
     "The framework.\nAnd the rest of the long article."),
    ('<article><p class="byline">By A. Writer</p><p>The text of the article.</p></article>', "By A. Writer\nThe text of the article."),
    ('<article><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="application/x-tex">x=2</annotation>'
     '</semantics></math> be.</p></article>', "Let x=2 be."),
    ('<article><p>Press <button>OK</button>and <svg><text>icon</text></svg>go on.</p></article>', "Press and go on."),
    ('<body><ul><li><a href="a">Home</a></li><li><a href="b">News</a></li></ul><article><p>The article itself.</p></article></body>', "The article itself."),
    ('<article><p>The text of the article.</p><div class="ad-slot-3">Buy</div><div class="shareButtons">Share</div>'
     '<div id="related-articles">More</div><p>Its end.</p></article>', "The text of the article.\nIts end."),
])
def test_names_remove_boxes_and_nothing_else(html, want):
    assert main_text(html) == want
