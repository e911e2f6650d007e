"""Main text of pages: layouts with known text, the given pages, malformed markup, growth."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from serieslab.llm import html_text
from serieslab.llm.q_html import op8_html

LONG = "Some long sentence, with commas, that goes on for quite a while so that it reads like text, really."
SHORT = "Short section, it is."
LAYOUTS = {
 'wrapper has-sidebar': (f'<body class="page has-sidebar"><div class="page has-sidebar"><header><h1>Site</h1></header><article><header class="entry-header"><h1 class="entry-title">T</h1></header><p>{LONG}</p><p>{SHORT}</p></article></div></body>', f'T\n{LONG}\n{SHORT}'),
 'sidebar-right wrapper': (f'<div class="layout sidebar-right"><div class="content"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div></div>', f'T\n{LONG}\n{LONG}'),
 'share-price': (f'<div class="share-price"><p>{LONG}</p><p>{LONG}</p></div>', f'{LONG}\n{LONG}'),
 'h1 beside': (f'<div id="wrap"><h1>Title here</h1><div class="body"><p>{LONG}</p><h2>H</h2><ul><li>a, b</li></ul><p>{LONG}</p></div><div class="comments"><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div></div>', f'Title here\n{LONG}\nH\na, b\n{LONG}'),
 'sections': (f'<main><section><h2>A</h2><p>{LONG}</p><p>{LONG}</p></section><section><h2>B</h2><p>{SHORT}</p></section><pre>code here</pre><table><tr><td>1</td><td>2</td></tr></table></main>', f'A\n{LONG}\n{LONG}\nB\n{SHORT}\ncode here\n1\n2'),
 'sections no main': (f'<div id="c"><div><h2>A</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><h2>B</h2><div><p>{SHORT}</p></div><div><p>{LONG}</p></div></div>', f'A\n{LONG}\n{LONG}\n{LONG}\nB\n{SHORT}\n{LONG}'),
 'form wrap': (f'<form id="aspnetForm"><div><p>{LONG}</p><p>{LONG}</p></div><div class="footer-links"><a href=x>foot</a></div></form>', f'{LONG}\n{LONG}'),
 'wp comments': (f'<article><h1>T</h1><p>{LONG}</p></article><div id="comments" class="comments-area"><ol class="comment-list"><li class="comment"><article class="comment-body"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></li></ol><div id="respond"><form><label>Name</label><input></form></div></div>', f'T\n{LONG}'),
 'ad inside': (f'<article><p>{LONG}</p><div class="ad">Buy, buy, buy now!</div><p>{LONG}</p><p class="newsletter-signup">Join, now</p><div class="cookie-notice">We use cookies, many</div></article>', f'{LONG}\n{LONG}'),
 'ad beside no article': (f'<body><nav>x</nav><div class="ad">Buy, buy, buy now!</div><div><h1>T</h1><p>{LONG}</p><p>{SHORT}</p><blockquote>q, r</blockquote></div><div class="notice">{LONG}</div><footer>f</footer></body>', f'T\n{LONG}\n{SHORT}\nq, r'),
 'body direct': (f'<body><h1>T</h1><p>{LONG}</p><p>{LONG}</p><ul class=menu><li>x</ul></body>', f'T\n{LONG}\n{LONG}'),
 'entities': (f'<article><p>a &lt;b&gt; &nbsp; c &eacute;&#233;&amp;amp; {LONG}</p></article>', f'a <b> c éé&amp; {LONG}'),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(("token", "kind"), [("has-sidebar", 0), ("sidebar", 2), ("share-price", 0), ("entry-header", 0), ("cookieBanner", 1), ("comment-12", 2), ("post-navigation", 1), ("adfoo", 0), ("sidebar-right", 1)])
def test_names(token, kind):
    assert html_text.named(token) == kind


def slow_reference(page):
    """The blocks of the one article of a simple page: what stands between block tags, without tags, references decoded."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1|article|div|ul|li)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_query_on_the_given_pages(spark, sf_dir):
    got = {r["page_id"]: r for r in op8_html(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        want = slow_reference(r["html"])
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_precision_and_recall_of_generated_pages():
    rng = random.Random(3)
    sentence = lambda n: " ".join(rng.choice(["river", "stone,", "quiet", "morning", "walked", "about", "seven,", "green"]) for _ in range(n)).capitalize() + "."
    found = wanted = right = 0
    for _ in range(300):
        texts = [sentence(rng.randint(12, 60)) for _ in range(rng.randint(2, 8))]
        blocks = [rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>"]).format(x) for x in texts]
        if rng.random() < 0.5:
            k = rng.randrange(len(blocks))
            blocks.insert(k, "<h2>Part heading</h2>")
            texts.insert(k, "Part heading")
        core = "".join(blocks)
        core = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', "<section>{}</section>"]).format(core)
        noise = [f'<div class="{rng.choice(["ad", "comments", "cookie-notice", "related-posts", "sidebar widget"])}"><p>{sentence(rng.randint(5, 40))}</p></div>' for _ in range(rng.randint(0, 4))]
        page = f'<html><body><nav><a href="/">Home page</a></nav>{"".join(noise[:2])}<div id="wrap">{core}</div>{"".join(noise[2:])}<footer>{sentence(20)}</footer></body></html>'
        got = html_text.main_text(page).split("\n")
        found += len(got)
        wanted += len(texts)
        right += len(set(got) & set(texts))
    assert right >= 0.98 * wanted and right >= 0.98 * found


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies, many cookies, and more cookies, really</div><div id="content"><h2>Head &amp; line</h2><p>First,  long paragraph
with, commas &eacute; and text that goes on for a good while, really it does.<br>After break</p><ul><li>one<li>two</ul></div>
<aside>related</aside><div class="comments"><p>Nice post, very, very, very, long, comment, with, many, commas, in, it, and so on.</p></div><footer>foot</footer>
<script>var t = "</p>";</script></body></html>"""


def test_main_text(spark):
    want = "Head & line\nFirst, long paragraph with, commas é and text that goes on for a good while, really it does. After break\none\ntwo"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<div><p>open <b>bold text") == "open bold text"
    assert len(html_text.main_text("<article><p>" + "word " * 100_000 + "</p></article>")) == 499_999
    assert html_text.main_text("<div>" * 5000 + "<p>deep text, deep</p>") == "deep text, deep"
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(rows).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, len(want)), (1, len(want)), (2, 0)]
    assert html_text.extract_text(rows.limit(0)).count() == 0



LONG = "A long paragraph, with commas, that goes on and on for quite a while, so that it reads like the text of an article and not like a notice."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<h1>Headline</h1><p>By Ann, May 1</p><div class=body><p>{P}</p></div>", "Headline\nBy Ann, May 1\n{P}"),
        ("<div><section><h2>A</h2><p>{P}</p></section><section><h2>B</h2><p>Final short remark.</p></section></div>", "A\n{P}\nB\nFinal short remark."),
        ("<article><p>{P}</p><div class=alert>We use things.</div><p>{P}</p></article>", "{P}\n{P}"),
        ("<article><p>{P}</p><div class=gdpr><p>We value your data.</p></div></article>", "{P}"),
        ("<div><p>{P}</p></div><label for=q>Search</label><input id=q>", "{P}"),
        ("<div><a href=/>Home</a> <a href=/b>News</a></div><h1>Headline</h1><div><p>{P}</p><p>End.</p></div><div><a href=/c>More</a></div>", "Headline\n{P}\nEnd."),
        ("<p>{P}</p><p>{P}</p><p>The end.</p><ul><li><a href=/x>Next story</a></li></ul>", "{P}\n{P}\nThe end."),
    ],
)
def test_pages_without_an_article(page, want):
    assert html_text.main_text("<html><body>" + page.replace("{P}", LONG) + "</body></html>") == want.replace("{P}", LONG)


def test_no_page_fails():
    rng = random.Random(1)
    bits = ["<", ">", "</", "<!", "<![", "<![CDATA[", "<?", "<!--", "-->", '"', "'", "=", "&", "&#", "&#x", "&#99999999;", "p", "div", "li", "td", "table", "script", "style", "title", "a", ' class="ad"', " ", "\x00", "é", "/", "article", "svg", "x, y", "form", "hidden"]
    for _ in range(5000):
        assert isinstance(html_text.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))), str)
    assert html_text.main_text("<![foo[x]]><p>a b</p>") == "a b"


@pytest.mark.parametrize("part", ["<div>", "<div><p>text, text", "<ul><span><li>x, y</span>", '<a b="', "<title>", "<!--", "< <", "< ", "<p>x, y</b></q>", "<td><tr>a"])
def test_time_grows_with_the_page(part):
    def took(n):
        start = time.perf_counter()
        html_text.main_text(part * n)
        return time.perf_counter() - start

    took(100)
    assert took(16_000) < 30 * max(took(2_000), 0.005)
