"""HTML extraction, URL rules with aliases, and the permutation index."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.llm import ann, html, urls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="main col-7"><h1>Head &amp; line</h1><p>First&nbsp;para <b>bold<br>next</p><p>Second &lt;tag&gt; &#233;
<ul><li>one<li>two</ul><div class="advert">Buy</div><form>Name <input></form><aside>See also</aside></div>
<div class="sidebar"><p>Side text that is long enough to look like an article at first sight, more text.</p></div>
<div id="comments"><p>Reader says hello with very many words that go on and on and on and on.</p></div>
<footer>&copy; host</footer></body></html>"""
TEXT = "Head & line\nFirst para bold next\nSecond <tag> é\none\ntwo"


@pytest.mark.parametrize("source, text", [
    (PAGE, TEXT), (PAGE.upper().replace("&AMP;", "&amp;").replace("&NBSP;", "&nbsp;").replace("&LT;", "&lt;").replace("&GT;", "&gt;"), TEXT.upper().replace("É", "é")),
    ("", ""), ("plain only", "plain only"), ("<p>a<p>b", "a\nb"), ("a < b & c", "a < b & c"), ("<p>cut <a hre", "cut"),
    ("<!-- x --><p>y<!-- open", "y"), ("<p>a</p></div></div>b", "a\nb"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ('<p title="a>b">c</p>', "c"), ("<script>x", ""), ("<p>" * 3000 + "deep", "deep"), ("<" * 5000 + "p>x", "<" * 4999 + "\nx")])
def test_single_pages(source, text):
    page = html.parse(source)
    assert page.text({page.best()}) == text


STORY = "<p>Story of some length, told in a paragraph.</p><p>And another one.</p>"


@pytest.mark.parametrize("wrapper, end", [
    ("<main class='site-main no-sidebar'>", "</main>"), ("<div class='content with-sidebar'>", "</div>"),
    ("<div id='page' class='header-fixed'>", "</div>"), ("<article class='related'>", "</article>"), ("<div class='has-comments'>", "</div>"),
    ("<div class='comments-open'>", "</div>"), ("<div class='widget'><div class='search-on'>", "</div></div>")])
def test_wrappers_with_a_marking_word_keep_the_article(wrapper, end):
    page = html.parse(f"<body><nav>Menu of the site</nav>{wrapper}{STORY}<div class='sidebar'>Side text</div>{end}<footer>host</footer></body>")
    assert page.text({page.best()}) == "Story of some length, told in a paragraph.\nAnd another one."
    assert html.votes_of(page)


def test_boxes_longer_than_the_article_stay_out():
    boxes = "<div class='comments'><p>" + "Words of a reader. " * 8 + "</p></div><div class='menu'>" + "<a>Some link text</a> " * 40 + "</div>"
    page = html.parse(f"<div class='post'>{STORY}</div>{boxes}")
    assert page.text({page.best()}) == "Story of some length, told in a paragraph.\nAnd another one."


def test_host_consensus(spark):
    body = "<div class='post-{k}'><p>Story {k} with a number of words in it.</p></div><div class='links-{k}'><p>{more}</p></div>"
    rows = [(k, "http://h.org/x", body.format(k=k, more="<a>Some other stories</a>")) for k in range(9)]
    # This page would give both containers; its host's other pages outvote it.
    rows += [(50, "http://h.org/y", body.format(k=50, more="Other stories of the week, and so on. " * 9)), (60, None, None), (61, "x", ""),
             (62, "http://other.org/", "<p>alone</p>"), (None, "http://h.org/z", body.format(k=3, more="")), (0, "http://h.org/x", rows[0][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, path string")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in html.main_text(pages).collect()))
    want = sorted([(k, f"Story {k} with a number of words in it.") for k in [*range(9), 0, 50]]
                  + [(60, ""), (61, ""), (62, "alone"), (-1, "Story 3 with a number of words in it.")])
    assert [(i, t) for i, t, _ in got] == want and all(n == len(t) for _, t, n in got)
    assert html.main_text(pages.limit(0)).count() == 0


RULES = [("net", "/", "net/", "block"), ("example.net", "/en/", "example.net/en/", "allow"),
         ("example.com", "/de/", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow")]


def judged(spark, rows):
    rules = spark.createDataFrame(RULES, "host string, path string, rule string, verdict string")
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, rule string").drop("rule")
    return {r.page_id: r for r in urls.judge(pages, rules, urls.alias_links(pages)).collect()}


def test_rules(spark):
    got = judged(spark, [
        (1, "HTTP://WWW.Example.NET/en/1?x#y", None), (2, "http://a.net/en/", None), (3, "http://net", None), (4, "http://example.com/de", None),
        (5, "http://m.example.com/de/1", None), (6, "x.org/fr/", None), (7, None, None), (8, "http://notnet/", ""), (9, "ftp://a.b.org/fr/z", None),
        (10, "://?q", None), (11, "http://É.net/", None), (12, "http://example.net/EN/", None), (13, "http://a://b.net/", None)])
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(1, 14)] == [
        ("www.example.net", "/en/1", "example.net/en/", "allow"), ("a.net", "/en/", "net/", "block"), ("net", "", None, "allow"),
        ("example.com", "/de", None, "allow"), ("m.example.com", "/de/1", "example.com/de/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("notnet", "/", None, "allow"), ("a.b.org", "/fr/z", "org/fr/", "allow"), ("", "", None, "allow"),
        ("É.net", "/", "net/", "block"), ("example.net", "/EN/", "net/", "block"), ("a:", "//b.net/", None, "allow")]


def test_blocks_reach_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    got = judged(spark, [
        (1, "http://a.com/1", link("http://bad.net/x")), (2, "http://b.com/2", link("HTTP://A.com/1#frag")),
        (3, "http://c.org/fr/3", link("http://b.com/2")), (4, "http://d.com/4", link("http://fine.com/")),
        (5, "http://e.com/5", '<meta http-equiv="Refresh" content="0; URL=\'http://c.org/fr/3\'">'),
        (6, "http://f.com/x/6", link("/y/7")), (7, "http://f.com/y/7", "<meta content='3;url=//bad.net/q' http-equiv=refresh>"),
        (8, "http://g.com/8", f"<!-- {link('http://bad.net/')} --><script>{link('http://bad.net/')}</script>"),
        (9, "http://g.com/9", '<a rel="canonical" href="http://bad.net/">'), (10, "http://h.com/a/10", link("sub?a=1&amp;b=2")),
        (11, "http://h.com/a/sub?a=1&b=2", link("http://bad.net/zz")), (12, "http://a.com/1", None)])
    assert {k for k, r in got.items() if r.verdict == "block"} == {1, 2, 5, 6, 7, 10, 11, 12}
    assert got[3].verdict == "allow" and got[3].why == "rule" and got[5].why == "alias" and got[4].why == "default"
    assert judged(spark, []) == {}


@pytest.mark.parametrize("target, page, address", [
    ("../z", "http://h.org/a/b/c", "http://h.org/a/z"), ("../../../z", "http://h.org/a/b", "http://h.org/z"), ("./", "http://h.org/a/b", "http://h.org/a/"),
    ("?q=1", "http://h.org/a?p", "http://h.org/a?q=1"), ("x", "http://h.org", "http://h.org/x"), ("//o.net/p", "https://h.org/", "https://o.net/p"),
    ("/y", "ftp://h.org/a", "ftp://h.org/y"), ("HTTPS://o.net", "http://h.org/", "HTTPS://o.net"), ("", "http://h.org/", None),
    ("//[x", "http://h.org/", None), ("x", "no address", None)])
def test_addresses_are_resolved(target, page, address):
    assert urls.resolved(target, page) == address


def test_blocks_reach_aliases_by_written_differently(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://bad.net/x", None), (2, "http://a.com/d/e/2", link("../2b")), (3, "http://a.com/d/2b", link("http://bad.net/x")),
            (4, "http://b.com/4", link("http:&#47;&#x2f;bad.net/x&#35;top")), (5, "http://c.com", link("http://bad.net/./q/../x")),
            (6, "http://d.com/6", link("http://c.com/")), (7, "http://e.com/7", "<base href='http://bad.net/s/'>" + link("../x")),
            (8, "http://f.com/8", "<link title='a=b' rel='canonical nofollow' href=http://bad.net/x>"), (9, "http://g.com/9", link("http://bad.net/x")[:-1]),
            (10, "http://h.com/10", link("http://i.com/?a=1&copy=2")), (11, "http://i.com?a=1&copy=2", link("http://bad.net/x")),
            (12, "http://j.com/12", "<link " + "a" * 100_000 + ">" + "<link " * 20_000)]
    got = judged(spark, rows)
    assert {k for k, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 10, 11}
    # Plain components over the links as they are meant.
    rules = spark.createDataFrame(RULES, "host string, path string, rule string, verdict string")
    pages = spark.createDataFrame([(*r, "n", "s", "a") for r in rows],
                                  "page_id bigint, url string, html string, node string, source string, alias string")
    again = {r.page_id: r.verdict for r in urls.judge(pages, rules, urls.alias_links(pages)).collect()}
    assert again == {k: r.verdict for k, r in got.items()}


@pytest.mark.parametrize("source, text", [
    ("<div>" * 50_000 + "deep" + "</div>" * 50_000, "deep"), ("<div>" * 50_000 + "</b>" * 50_000 + "deep", "deep"),
    ("<b><p>" + "<i>" * 50_000 + "</b>" * 50_000 + "deep", "deep"), ("<i>" * 50_000 + "<p>a</p>" * 3 + "deep", "a\na\na\ndeep"),
    ("<div class='" + "x " * 50_000 + "'><section class='" + "y" * 50_000 + "'>deep", "deep")])
def test_deep_and_broken_pages_are_linear(source, text):
    begin = time.perf_counter()
    page = html.parse(source)
    votes = html.votes_of(page)
    assert page.text({page.best()}) == text and html.extract(page, list(votes)[:5])[0] == text
    assert max(map(len, votes)) <= html.PATH_CHARS
    # Walking 50,000 open elements 50,000 times took minutes.
    assert time.perf_counter() - begin < 20


def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)).round(1)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000 + k, [1.0] * 8) for k in range(40)] \
        + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, []), (2005, [float("inf")] * 8),
           (None, [1.0] * 8), (3, vectors[3].tolist()), (3000, [1.0, 2.0]), (3001, [1.0, 3.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 10 == 0, k=5, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    fine = {i: np.asarray(v) for i, v in rows if i is not None and v and i < 2000} | {3000: np.asarray([1.0, 2.0]), 3001: np.asarray([1.0, 3.0])}
    want = {}
    for q in fine:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
            want[q] = [(i, s) for s, i in near[:5]]
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in got for (_, s), (_, t) in zip(got[q], want[q]))
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, stack = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], float)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        far = ((stack - stack[ids == q][0]) ** 2).sum(1)
        far[ids == q] = np.inf
        hits += len(found & set(ids[np.lexsort((ids, far))[:10]].tolist()))
    assert len(got) == sum(ids % 20 == 0) and hits >= 0.95 * 10 * len(got)


@pytest.mark.parametrize("lengths", [1, 16])
def test_rare_lengths_lose_no_neighbour(spark, monkeypatch, lengths):
    """A length without pivots is searched whole, a rare one with pivots of its own."""
    monkeypatch.setattr(ann, "LENGTHS", lengths)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(900)] + [(1000 + k, rng.normal(size=4).tolist()) for k in range(600)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 50 == 0, k=10).collect()
    fine = {i: np.asarray(v) for i, v in rows}
    hits = {4: [], 6: []}
    for q in (i for i in fine if i % 50 == 0):
        near = sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:10]
        hits[len(fine[q])].append(len({i for _, i in near} & {r.vec_id for r in got if r.query_id == q}) / 10)
    assert np.mean(hits[6]) >= 0.9 and np.mean(hits[4]) >= (1.0 if lengths == 1 else 0.9)
    with pytest.raises(ValueError):
        ann.nearest(table, F.lit(True), pivots=257)
