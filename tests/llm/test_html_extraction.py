"""Operator 12: pages of known text in many shapes, the host's vote, and all given pages against their articles."""

import html
import re
import time

import pytest

from weftgraph.llm import html_extraction
from weftgraph.llm.html_extraction import extract, parsed, text_of, votes
from weftgraph.llm.queries import op12_html_extraction

DATA = "/root/testdata/sf0.01"
P = "Plain words of a paragraph that is long enough to count."


def own(page):
    found = parsed(page)
    best = votes(found)
    return text_of(found, best[0][0]) if best else ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p>{P}</article><footer>x</footer>", f"T & t {P}"),
        (f"<div class=wrap><div id=sidebar><p>{P} {P}</p></div><div class=post><h2>H</h2><p>{P}</p><p>a<b>b</b> c<br>d</p></div></div>", f"H {P} ab c d"),
        (f"<article><header><p>by me</p><h1>Title</h1></header><p>{P}</p><aside>no</aside><form>no<input></form></article>", f"Title {P}"),
        (f"<article><p>{P}</p><div class='ad-box'>buy</div><section id=comments><article><p>{P} {P} {P}</p></article></section></article>", P),
        (f"<div class=cookie-notice>We use</div><p>{P}<p>{P}", f"{P} {P}"),
        (f"<main><h1>A</h1><section><p>{P}</section><section><p>{P}</section></main>", f"A {P} {P}"),
        (f"<div class=story><h1>A</h1><section><p>{P}</p></section><section><p>{P}</p></section></div><div class=x>small</div>", f"A {P} {P}"),
        (f"<article><ul><li>one<li>two <a href=x>link</a></ul><table><tr><td>a<td>b</table><p>{P}</article>", f"one two link a b {P}"),
        (f"<body><ul><li><a>Home</a><li><a>News</a></ul><div><p>{P}</p></div>", P),
        (f"<article><p title='a > b'>x &lt; y &#x41;&nbsp;z 1 < 2</p>\n<p>\n {P}\t\n</p></article>", f"x < y A z 1 < 2 {P}"),
        (f"<article><script>var t='</p><p>no';</script><style>p{{}}</style><!-- <p>no --><p>{P}</p><template><p>no</p></template></article>", P),
        (f"<article><p>{P} &am", f"{P} &am"),
        (f"<article><p>{P}</p><a href='/cut", P),
        (f"<ARTICLE><P CLASS=Intro>{P}</P></ARTICLE><DIV HIDDEN><p>{P} {P}</p></DIV>", P),
        (f"<div class=entry><div class=entry-header><h1>T</h1></div><p>{P}</p></div>", P),
        (f"<article><div class=post-header><h1>T</h1><p>by</p></div><p>{P}</p></article>", f"T {P}"),
        ("<nav><a>x</a></nav>", ""),
        ("", ""),
        ("just words, no tags", "just words, no tags"),
        ("a < b <3 & c", "a < b <3 & c"),
    ],
)
def test_shapes(page, text):
    assert own(page) == text


def test_the_host_decides_where_a_page_alone_would_not(spark):
    article = "<div class='c{k}'><p>{text}</p></div><div class='r'><p>{talk}</p></div>"
    rows = [(k, f"http://h.example/{k}", article.format(k="a", text=f"{P} {k} " * 4, talk="short talk")) for k in range(6)]
    rows += [(6, "http://h.example/6", article.format(k="a", text=P, talk=f"{P} " * 9)), (7, "http://other.example/", rows[0][2]), (8, None, rows[0][2])]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[6]["text"] == P and got[6]["by_host"] and not got[8]["by_host"]
    assert got[0]["text"] == got[7]["text"] == got[8]["text"] == " ".join((f"{P} 0 " * 4).split())


@pytest.mark.parametrize("hosts", [20_000, 0])
def test_awkward_rows(spark, monkeypatch, hosts):
    monkeypatch.setattr(html_extraction, "BROADCAST_HOSTS", hosts)
    good = f"<article><p>{P}</p></article>"
    rows = [(1, None, None), (None, "", ""), (2, "no address", good), (3, "http://A.example:80/x?y", good), (3, "http://A.example:80/x?y", good), (4, "http://a.example", "<p" * 50)]
    frame = spark.createDataFrame([(*r, "o", "o", 1) for r in rows], "page_id long, url string, html string, text string, host string, n_chars int")
    got = sorted((repr((r["page_id"], r["url"], r["text"], r["n_chars"])) for r in extract(frame).collect()))
    assert got == sorted(repr((i, u, P if h == good else "", len(P) if h == good else 0)) for i, u, h in rows)
    assert extract(frame.limit(0)).count() == 0


def test_registered_query_over_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r["page_id"]: r for r in op12_html_extraction(spark, DATA).collect()}
    assert len(got) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"], got[page["page_id"]]["url"]) == (want, len(want), page["url"])


@pytest.mark.parametrize("piece", ["<div>", "<b>x", "<p><b>x<br>", "</i>", "<ul><li>", "<a b='", "<table><tr><td>", "<!--", "<", "&amp;", "<header>", "<div class=a1>x"])
def test_long_pages_take_linear_time(piece):
    began = time.thread_time()
    page = parsed(piece * 60_000)
    for path, _ in votes(page)[:1]:
        text_of(page, path)
    assert time.thread_time() - began < 12
