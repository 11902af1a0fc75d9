"""op9: articles of known pages."""

import random
import re
import time
import tracemalloc
from html import unescape

import pytest
from conftest import SF_SMALL

from loomstat.llm import tag_paths
from loomstat.llm.tag_paths import extract, main_text

LONG = "A sentence, with some words in it, that goes on for a while. Another one follows; it is no shorter."


def test_small_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(html)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", html[r["page_id"]], re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\0", inner)).split("\0")
        want = "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("plain text &amp; more", "plain text & more"), ("<p>", ""), ("<script>var a = '<p>x</p>'", ""),
    (f"<body><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav><div id=main><h1>Title of it</h1><p>{LONG}<p>{LONG}<div class='cookie-notice'>{LONG}</div></div><footer>© us</footer>",
     f"Title of it\n{LONG}\n{LONG}"),
    (f"<article><header><h1>T, one.</h1></header><p>a&nbsp;&lt;b&gt;  c\n d. {LONG}</p><form>Your name</form><section class=comments><p>{LONG}</p></section></article>",
     f"T, one.\na <b> c d. {LONG}"),
    (f"<main><p>{LONG}<b>bo</b>ld<br>next</p><!-- <p>{LONG}</p> --><aside>{LONG}</aside></main>", f"{LONG}bold\nnext"),
    (f"<table><tr><td>x<td><p>{LONG}</p></table>", f"x\n{LONG}"),  # a cell beside the text is part of it
])
def test_pages(html, want):
    assert main_text(html) == want


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "<p>" + "word, " * 200_000, 2), (1, "u", "<p>x.", 2)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 2), (1, 1_199_999)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("article", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div><div><p>x</div>"])
def test_nothing_of_the_article_is_dropped_for_its_ratio(article):
    body = (f"<h1>Title</h1><p>{LONG * 4}</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>1</td></tr></table>"
            f"<pre>x = 1</pre><blockquote>So</blockquote><section><div><h2>Part</h2></div><p>{LONG * 9}</p></section>")
    page = "<body><nav><a>Home</a></nav>" + article.format(body) + "<footer>us</footer>"
    want = f"Title\n{LONG * 4}\none\ntwo\na\n1\nx = 1\nSo\nPart\n{LONG * 9}"
    assert main_text(page) == want


@pytest.mark.parametrize(("html", "want"), [
    (f"<div class='layout has-sidebar'><article><p>{LONG}</article><div class=sidebar>{LONG}</div></div>", LONG),
    (f"<div class='post comments-open'><article><p>{LONG}</article></div>", LONG),
    (f"<div class='post comments-open no-share'><p>{LONG}</div>", LONG),
    (f"<article><div class=entry-header><h1>Title</h1></div><p>{LONG}<div class=share>{LONG}</div></article>", f"Title\n{LONG}"),
    (f"<div class=content-sidebar-wrap><main><p>{LONG}</main></div>", LONG),
    (f"<main><h1>T</h1><div class=sidebar-layout><article><p>{LONG}</article><div class=sidebar>{LONG}</div></div></main>", f"T\n{LONG}"),
    (f"<div id=page-widget><p>{LONG}<p>{LONG}</div><div class=related><p>{LONG}</div>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</article><div class=related><article><p>{LONG}</article></div>", LONG),
    (f"<main><p>{LONG}<div class=comments><article><p>Nice.</article></div></main>", LONG),
    (f"<main><p>{LONG}<div class='nav-header'>{LONG}</div></main>", LONG),
])
def test_names_of_wrappers(html, want):
    assert main_text(html) == want


def _pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()


def test_the_ratios_decide(monkeypatch):
    """Without the marks the ratios find the same text; with the ratios switched off it changes."""
    pages = _pages()
    plain = [re.sub(r"(</?)article", r"\1div", p) for p in pages]
    marked = [main_text(p) for p in pages]
    found = [main_text(p) for p in plain]
    assert sum(a == b for a, b in zip(marked, found, strict=True)) >= 0.95 * len(pages)
    monkeypatch.setattr(tag_paths, "content_paths", set)
    assert sum(main_text(p) == b for p, b in zip(plain, found, strict=True)) <= 0.1 * len(pages)


def test_smoothed_ratios_against_all_pairs():
    """The two passes over the path tree against every pair of paths."""
    rng = random.Random(4)
    for _ in range(30):
        paths = [tag_paths._Path(0, -1, False, False)]
        for i in range(1, rng.randrange(2, 40)):
            paths.append(tag_paths._Path(i, rng.randrange(i), rng.random() < 0.2, rng.random() < 0.3))
        for p in paths:
            p.nodes = rng.choice([0, 1, 1, 3])
            p.length, p.punct = rng.randrange(1, 900) * bool(p.nodes), rng.randrange(20) * bool(p.nodes)
        paths[-1].nodes, paths[-1].length = 1, 50

        def up(p):
            return [p.at] + (up(paths[p.above]) if p.above >= 0 else [])

        def weight(p, q):
            a, b = up(p), up(q)
            return tag_paths.FALL ** (len(a) + len(b) - 2 * len(set(a) & set(b)))

        fused = {}
        for p in paths:
            if p.nodes:
                ws = [(weight(p, q), q) for q in paths if q.nodes]
                length, punct = (sum(w * x for w, x in v) for v in ([(w, q.length / q.nodes) for w, q in ws], [(w, (q.punct + 1) / q.nodes) for w, q in ws]))
                fused[p] = (length * punct) ** 0.5 / sum(w for w, _ in ws) * (tag_paths.PART if p.part else tag_paths.INSIDE if p.holds else 1)
        want = {p for p, v in fused.items() if v >= tag_paths.KEEP * max(fused.values()) * (1 + 1e-9) and not p.part}
        assert tag_paths.content_paths(paths) == want


@pytest.mark.parametrize(("html", "want"), [
    (f"<article><h1>T</h1><p>{LONG}</p><div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></div><p>{LONG}</p></article>", f"T\n{LONG}\n{LONG}"),
    (f"<div><h1><a>T</a></h1><p>{LONG}<a>link</a>.</p><ul><li>one<li>two</ul><p>{LONG}</p></div><div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></div>",
     f"T\n{LONG}link.\none\ntwo\n{LONG}"),
    (f"<div><ul><li><a>Home</a><li><a>News</a></ul><div><h2>T</h2><p>{LONG * 3}</p></div><table><tr><td>Copyright us</table></div>", f"T\n{LONG * 3}"),
    (f"<main><h1>Only a title</h1></main><div><p>{LONG * 3}</p><p>{LONG * 3}</p></div>", f"{LONG * 3}\n{LONG * 3}"),  # the mark is a prior, no answer
    (f"<p title=it's>{LONG}<p title='a > b' class=x>{LONG}", f"{LONG}\n{LONG}"), (f"<p>1 < 2, {LONG} <", f"1 < 2, {LONG} <"), (f"<!-- <p>x</p><p>{LONG}", ""),
])
def test_unmarked_clutter_and_odd_markup(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("html", [
    "".join(f"<div class=c{i}><p>some text, here.</p></div>" for i in range(2000)), "<div>x" * 50_000, "<a '" * 250_000, "<a b='" * 170_000 + ">",
    "<span>" * 50_000 + "<p>x</p></b>" * 20_000, "<" * 1_000_000, "<a x=\" '>" * 100_000, "<li>" * 60_000 + "x", "<!" * 300_000, "<!--" * 200_000])
def test_time_and_memory_are_linear(html):
    tracemalloc.start()
    begin = time.process_time()
    main_text(html)
    traced = time.process_time() - begin
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert traced < 20 and peak < 200 << 20  # tracing itself takes most of the time
