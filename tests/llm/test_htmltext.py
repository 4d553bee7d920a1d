"""Main text: the pages of the test tables by a plain reading, markup by cases, weights, odd rows."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from tickloom.llm import htmltext as H
from tickloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


def plain(page):
    """Of pages whose article holds only h1, p, b and br."""
    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " "))
    parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def text(page, weights=None):
    return H.main_text(page, weights or H.Weights({H.WORD: 1.0, H.INSIDE: 9.0, H.BESIDE: -9.0, "<p": -0.1, "<h1": -0.1, "<div": -5.0}, -2.0))


def test_query_equals_a_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = Q.op12_main_text(spark, SF).collect()
    assert len(got) == len(pages) > 100
    for r in got:
        assert (r.text, r.url, r.n_chars) == (plain(pages[r.page_id].html), pages[r.page_id].url, len(r.text))


def test_scan_equals_all_runs():
    """The best of all runs of blocks, each summed anew."""
    w = H.Weights({H.WORD: 0.5, "<p": -0.2, "<div": -3.0, "<li": -1.0, "<ul": -2.0}, -1.0)
    page = "<div>one<ul><li>two<li>three</ul></div><p>a b c d e<p>f g h</p><div><div>i j k l m n</div></div><ul><li>o<li>p q</ul><p>r s t u v w x y</p>"
    blocks = H.blocks_of(page)
    best = max(
        ((sum(b.words * 0.5 + sum(map(w.tag, b.inner)) for b in blocks[i:j]) + sum(w.tag(t) for b in blocks[i + 1 : j] for t in b.tags), -i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)),
    )
    assert H.main_text(page, w) == "\n".join(b.text for b in blocks[-best[1] : best[2]])


@pytest.mark.parametrize("page, want", [
    ("<nav>menu</nav><header>top</header><article><header><h1>Title</h1></header><p>Body &amp; more</p></article><footer>end</footer>", "Title\nBody & more"),
    ("<article><p>a <b>b</b>c<br>d\n\t e</p></article>", "a bc d e"),
    ("<article>one<aside>side</aside>two<div class='ad-slot'>buy</div>three<form><p>mail</p></form>four</article>", "one\ntwo\nthree\nfour"),
    ("<article><p>x</p><div class='cookie-notice'>ok?</div><section id=comments><article class=comment><p>nice</p></article></section></article>", "x"),
    ("<main><p>long enough words here</p></main><p>beside it</p>", "long enough words here"),
    ("<main><p>around</p><article><p>inner text</p></article></main>", "inner text"),
    ("<div class=ad>never closed<article><p>text</p></article>", "text"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article><script>var t = '</p><p>no';</script><style>p{}</style><p>yes</p></article>", "yes"),
    ("<article><p title='a>b'>q</p><!-- <p>no</p> --><p>r</p></article>", "q\nr"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
    ("<article><p>&#x41;&nbsp;&eacute;&lt;b&gt;</p></article>", "A é<b>"),
    ("<article><div class='page no-sidebar'>kept</div><div class=sidebarLeft>gone</div><div class=shadow>kept too</div></article>", "kept\nkept too"),
    ("<body><div class='top-menu'>a b</div><p>some words stand here</p></body>", "some words stand here"),
    ("<body><div class='site-header'>a name</div><div class=topnav>a b</div><p>some words stand here</p><ol class=commentlist><li>first!</ol></body>", "some words stand here"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p class=commentary>kept</p><div id=usercomments>gone</div></article>", "Title\nkept"),
    ("a < b and 5 > 3", "a < b and 5 > 3"),
    ("", ""), ("<", "<"), ("<p", ""), ("<!--", ""), ("<article></article>", ""), ("<nav>only a menu</nav>", ""),
])
def test_cases(page, want):
    assert text(page) == want


def test_weights_of_labelled_pages():
    pages = ["<nav><ul><li><a>m</a></li></ul></nav><article><h1>t</h1><p>a b c d</p><p>e f g h i</p></article><div>out</div>"] * 20
    counts = H.Counter()
    for p in pages:
        counts.update(H.counted(p))
    w = H.weights_from(counts)
    assert w.word(H.WORD) > 0 and w.word(H.INSIDE) > 1 and w.word(H.BESIDE) < -1
    assert all(w.tag(t) < 0 for t in ("p", "div", "li", "nav", "unheard-of")) and w.tag("div") < w.tag("p")
    assert H.counted("<p>no mark</p>") is None
    # A page without a mark is read by what the others taught.
    assert H.main_text("<ul><li><a>m</a><li><a>n</a></ul><p>a b c d e</p><p>f g h</p><div>x</div>", w) == "a b c d e\nf g h"


@pytest.mark.parametrize("piece", ["<b>", "<p>", "<div>", "</div>", "<div class=ad>", "<", "<a b='", "<a b=", "<!--", "<!", "&#", "<script>", "x ", "<a "])
def test_long_pages_take_time_by_length(piece):
    t0 = time.perf_counter()
    text(piece * 200_000)
    assert time.perf_counter() - t0 < 10


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None, "t", 5), (2, "", None, None), (3, "<article><p>x</p></article>", "u", 1), (3, "<article><p>x</p></article>", "u", 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long")
    got = H.extracted(df, H.learned(df))
    assert got.columns == ["page_id", "html", "text", "n_chars", "text_", "n_chars_"]
    assert sorted((r.page_id, r.text_, r.n_chars_) for r in got.collect()) == [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    empty = df.filter(F.lit(False))
    assert H.learned(empty).scores == {} and H.extracted(empty, H.Weights()).count() == 0
