"""Main text and site templates: what must stay, what must go, and the two ways of dealing the lists."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import html

SCHEMA = "page_id long, url string, html string, key string, text string, drop string, host string, salt string, hash string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x", "x", "x") for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()}


def test_an_article_served_under_many_addresses_stays(spark):
    story = '<article><div class="body"><p>Same story</p></div></article>'
    rows = [(i, f"http://a.b/{i}", f"<body><h2>Heading {i}</h2>{story}</body>") for i in range(8)]
    rows += [(10 + i, f"http://c.d/?v={i}", f"<article><h1>V{i}</h1><div><p>One long story, told again with another heading.</p></div></article>") for i in range(8)]
    got = texts(spark, rows)
    assert all(got[i] == "Same story" for i in range(8))
    assert all(got[10 + i] == f"V{i}\nOne long story, told again with another heading." for i in range(8))


def test_a_template_goes_at_its_border(spark, monkeypatch):
    """Pages of one host: a box on LEAST_PAGES of them goes, on one less it stays, and it needs its share of a large host."""
    box = "<div><span>Box</span></div>"
    page = lambda i, own: f"<article><p>Story number {i} of the house</p>{own}</article>"
    least = html.LEAST_PAGES
    few = [(i, "http://a.b/", page(i, box if i < least else "")) for i in range(20)]
    assert all("Box" not in t for t in texts(spark, few).values())
    fewer = [(i, "http://a.b/", page(i, box if i < least - 1 else "")) for i in range(20)]
    assert sum("Box" in t for t in texts(spark, fewer).values()) == least - 1
    large = [(i, "http://a.b/", page(i, box if i < least else "")) for i in range(int(least / html.SHARE) + 5)]
    assert sum("Box" in t for t in texts(spark, large).values()) == least
    monkeypatch.setattr(html, "MANY_PAGES", least)
    assert all("Box" not in t for t in texts(spark, large).values())
    copies = [(i, "http://a.b/", page(0, box)) for i in range(20)] + [(None, "http://a.b/", page(0, box))]
    assert all("Box" in t for t in texts(spark, copies).values()) and None in texts(spark, copies)  # copies are one page


def test_a_planted_template_is_removed_from_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    clean = {r.page_id: r.text for r in html.extract(pages).collect()}
    planted = pages.withColumn("html", F.regexp_replace("html", "</h1>", "</h1><div><span>Read this on our partner sites</span></div>"))
    hosts = {r.h for r in pages.groupBy(html.host_of("url").alias("h")).count().filter("count >= 5").collect()}
    host = {r.page_id: r.h for r in pages.select("page_id", html.host_of("url").alias("h")).collect()}
    got = {r.page_id: r.text for r in html.extract(planted).collect()}
    own = {r.page_id: html.main_text(r.html) for r in planted.collect()}
    assert any(own[i] != clean[i] for i in own)
    assert all(got[i] == clean[i] for i in got if host[i] in hosts) and sum(host[i] in hosts for i in got) > 50
    assert all(got[i] == own[i] for i in got if host[i] not in hosts)


def test_dealt_lists_give_the_same_texts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.x/{i}", f"<body><div>Site {i % 3} of the net</div><div><p>A story with the number {i} and more</p></div></body>") for i in range(60)]
    rows += [(None, None, None), (70, "", ""), (71, "http://h0.x/?a", rows[0][2]), (72, "http://h0.x/0", rows[0][2])]
    shared = sorted((r.page_id or -1, r.url or "", r.text) for r in html.extract(pages_of(spark, rows)).collect())
    monkeypatch.setattr(html, "FEW", 0)
    dealt = html.extract(pages_of(spark, rows))
    assert dealt.schema == html.extract(pages_of(spark, [])).schema
    assert sorted((r.page_id or -1, r.url or "", r.text) for r in dealt.collect()) == shared
    assert all("Site" not in t for i, _, t in shared if 0 <= i < 60)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article>one</article><aside>x</aside><article>two longer</article>", "one\ntwo longer"),
        ("<main><h1>T</h1><article>A</article><div class='comments'>c</div></main>", "T\nA"),
        ("a &am<b>p;</b> b &lt;i&gt;", "a &amp; b <i>"),
        ("a<![CDATA[ &amp; ]]>b", "a &amp; b"),
        ("<div>" * 300 + "<nav>menu</nav>text", "text"),
        ("<div>" * 254 + "<nav>menu</nav>text", "text"),
        ("<article>a<article class=comment>c</article></article>", "a"),
        ("<article class='post related'>kept</article>", "kept"),
        ("x&nbsp;&nbsp;y\n\n z", "x y z"),
        ("<p>" + "word " * 200_000, ("word " * 200_000).strip()),
    ],
)
def test_pages_by_hand(page, want):
    assert html.main_text(page) == want


def test_long_and_deep_pages_take_linear_time():
    for page in ("<div>" * 30_000 + "x", "<b>" * 30_000 + "y</i>" * 3000, "<ul><li>" * 20_000 + "z", "<b><p>" * 20_000, "</p>" * 30_000):
        assert len(html.main_text(page)) <= 3000 and html.page_hashes(page)


def test_counts_alone_clean_a_site(spark, monkeypatch):
    """Without the class list: menus, notices and footers of a site's pages go by their count, marked or not, with or without articles."""
    parts = ['<div class="menu"><a href="/">Start</a> <a href="/x">Other things</a></div>', '<div class="cookie-notice">We use cookies here</div>', "<div><p>All rights belong to us</p></div>", "<section>Call us today</section>"]
    page = lambda i, tag: f"<html><body>{parts[0]}{parts[1]}<{tag}><p>Page {i} says {i * 7919} new things of its own, at some length.</p></{tag}>{parts[2]}{parts[3]}</body></html>"
    rows = [(i, f"http://a.net/{i}", page(i, "div" if i % 2 else "article")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html.templates(pages).collect()
    assert len(found) >= 4 and all(r.n_pages == 40 for r in found)
    monkeypatch.setattr(html, "MARKED", html.re.compile("(?!)"))
    drop = frozenset(r.hash for r in found)
    for i, _, text in rows:
        assert html.main_text(text, drop) == f"Page {i} says {i * 7919} new things of its own, at some length."
    assert "cookies" in html.main_text(rows[1][2])
