"""Operators on small fixtures, and the catalogue against its SQL."""

import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from weftlake.functions.dom import parse
from weftlake.operators import content, document, feeds, inspect, links, rules, scoring, search
from weftlake.plans import catalog
from weftlake.sources import feeds as sources
from weftlake.streaming import feeds as stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    want, got = con.sql(catalog.SQL[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda d: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_catalogue_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0 or name == "latex_to_unicode"


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title><link>https://s</link><description>d</description>
<item><title>A &amp;amp; B</title><link>https://s/1</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 02 Jan 2024 15:04:05 +0000</pubDate><dc:creator>Ann</dc:creator></item>
<item><title>C</title><link>https://s/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>At</title><link href="https://a"/><entry><id>e1</id><title>E</title><link rel="self" href="https://a/self"/><link rel="alternate" href="https://a/1"/><updated>2024-01-02T00:00:00Z</updated><author><name>Bo</name></author></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>R</title></channel><item><title>X</title><link>https://r/1</link></item></rdf:RDF>"""


def test_feed_formats(spark):
    bodies = spark.createDataFrame([("rss", "﻿" + RSS), ("atom", ATOM), ("rdf", RDF), ("bad", "no feed"), ("none", None)], "feed_url string, body string")
    parsed = {r.feed_url: r for r in sources.parse_feeds(bodies).collect()}
    assert (parsed["rss"].type, parsed["rss"].title, parsed["atom"].type, parsed["rdf"].type, parsed["bad"].type, parsed["none"].type) == ("rss", "T", "atom", "rss", None, None)
    items = {(r.feed_url, r.ord): r for r in sources.feed_items(sources.parse_feeds(bodies)).collect()}
    assert len(items) == 4
    a = items["rss", 0]
    assert (a.guid, a.title, a.author, a.published) == ("g1", "A & B", "Ann", dt.datetime(2024, 1, 2, 15, 4, 5))
    assert len(items["rss", 1].guid) == 16 and items["rss", 1].published is None
    assert (items["atom", 0].link, items["atom", 0].author) == ("https://a/1", "Bo") and len(items["rdf", 0].guid) == 16


def test_opml(spark):
    source = '<opml><body><outline text="News"><outline text="Deep"><outline text="a" title="A" xmlUrl="https://a" htmlUrl="https://s"/></outline></outline><outline text="B" xmlUrl="https://b"/></body></opml>'
    got = sources.read_opml(source)
    assert [(f["url"], f["title"], f["category"]) for f in got] == [("https://a", "A", "News/Deep"), ("https://b", "B", "")]
    df = spark.createDataFrame([(f["url"], f["title"], f["site_url"], f["category"]) for f in got], "url string, title string, site_url string, category string")
    again = sources.read_opml(sources.write_opml(df, "mine & yours"))
    assert sorted((f["url"], f["category"]) for f in again) == [("https://a", "News/Deep"), ("https://b", "")]
    assert sources.opml_feeds(spark.createDataFrame([("x", source), ("y", "<bad"), ("z", None)], "path string, body string")).count() == 2
    with pytest.raises(ValueError):
        sources.read_opml("<x")
    more = spark.createDataFrame([("HTTPS://A", "dup"), ("https://c", "C"), ("https://C", "D")], "url string, title string")
    assert feeds.merge_feeds(df, more).count() == 3


def _items(spark, rows):
    return spark.createDataFrame([(f, g, dt.datetime(2024, 1, d)) for f, g, d in rows], "feed_url string, guid string, published timestamp")


def test_feed_state(spark):
    items = _items(spark, [("f", "a", 1), ("f", "b", 2), ("g", "c", 3)])
    new, added = feeds.upsert(items, _items(spark, [("f", "b", 2), ("f", "d", 5), ("f", "e", 4)]), 2)
    assert {(r.feed_url, r.guid) for r in new.collect()} == {("f", "d"), ("f", "e"), ("g", "c")} and added.collect()[0].added == 2
    again, added = feeds.upsert(new, _items(spark, [("f", "b", 2)]), 2)
    assert added.collect()[0].added == 1 and {r.guid for r in again.collect()} == {"d", "e", "c"}  # an evicted guid counts as new, and is evicted again
    log = spark.createDataFrame([("a", "read", 1), ("a", "unread", 2), ("b", "read", 1)], "guid string, op string, at int")
    assert [r.guid for r in feeds.fold_marks(log).collect()] == ["b"]
    assert {(r.feed_url, r.unread) for r in feeds.unread_counts(items, feeds.fold_marks(log)).collect()} == {("f", 1), ("g", 1)}


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "polls"
    src.mkdir()
    polls = [("r", RSS, ""), ("a", ATOM, ""), ("r", RSS, ""), ("x", "", "timeout")]
    for k, (url, body, error) in enumerate(polls):
        (src / f"{k}.json").write_text(json.dumps({"feed_url": url, "fetched_at": "2024-01-01T00:00:00", "body": body, "error": error}))
        os.utime(src / f"{k}.json", (k, k))
    counts = []
    q = stream.poll_batches(stream.read_polls(spark, str(src), 1), str(tmp_path / "items"), str(tmp_path / "ck"), 100, lambda d, n: counts.append({r.feed_url: r.added for r in d.collect()}))
    q.awaitTermination()
    stored = stream.stored_items(spark, str(tmp_path / "items"))
    assert {(r.feed_url, r.title) for r in stored.collect()} == {("r", "A & B"), ("r", "C"), ("a", "E")}
    assert counts[0] == {"r": 2} and counts[2] == {}


def test_streaming_state(spark, tmp_path):
    src = tmp_path / "items"
    for k, rows in enumerate([[("f", "a", 1), ("f", "b", 2)], [("f", "a", 1), ("f", "c", 3)], [("f", "a", 1)]]):
        _items(spark, rows).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("feed_url string, guid string, published timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    seen = []
    q = stream.newest_state(s, 2).writeStream.outputMode("update").foreachBatch(lambda d, n: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.new_items, r.kept) for r in seen] == [(2, 2), (1, 2), (1, 2)]


PAGE = """<html lang="en-GB"><head><title>My  page</title><meta name="theme-color" content="#f60"><link rel="alternate" type="application/rss+xml" href="/f.xml" title="F"></head><body>
<nav aria-label="Top"><a href="/a">A</a><a href="/b">B</a></nav><main><article><h1 id="t">Head <span>Head</span></h1><p>Text with <a href="/x">link</a> and <img src="/i/pic.png"></p>
<ul><li>one</li><li>two</li></ul><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td><a href="/c">two</a></td></tr></table><pre>a
 b</pre></article></main><footer>no links</footer></body></html>"""


def test_content(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", PAGE), (2, "https://e.com/2", None), (3, "u", "<div>" * 700)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in content.page_parts(pages, ["lang", "title", "feeds", "navigation", "cells", "theme"]).collect()}
    assert (rows[1].lang, rows[1].title, rows[1].feeds[0].url, rows[1].navigation[0].label, len(rows[1].navigation)) == ("en", "My page", "/f.xml", "Top", 1)
    assert [(c.row, c.col, c.text, c.href) for c in rows[1].cells][-1] == (1, 1, "two", "/c") and rows[3].parse_error and not rows[2].parse_error
    kinds = [r.type for r in content.content_of(pages.where("page_id = 1")).orderBy("ord").collect()]
    assert kinds[0] == "heading1" and {"paragraph", "link", "list", "list_item", "table", "table_row", "table_cell", "code_block"} <= set(kinds)
    nodes = parse(PAGE)
    assert nodes[content.content_root(nodes)].tag == "article" and content.content_nodes(nodes, content.content_root(nodes))[0]["text"] == "Head"
    assert spark.range(1).select(links.theme_colour(F.array(F.lit("#000000"), F.lit(""), F.lit("#f60"))).alias("c")).first().c == "#ff6600"


def test_articles():
    card = '<div><h2><a href="/{0}">Story number {0} here</a></h2><p>A description of more than thirty bytes of it.</p><time datetime="2024-01-0{0}">x</time></div>'
    nodes = parse("<body><div>" + "".join(card.format(k) for k in (1, 2, 3)) + '<div class="sponsored"><h2><a href="/ad">Buy this thing now</a></h2></div></div></body>')
    root = content.content_root(nodes)
    got = content.articles(nodes, root)
    assert [(a["title"], a["href"], a["date"]) for a in got] == [(f"Story number {k} here", f"/{k}", f"Jan {k}, 2024") for k in (1, 2, 3)]


def test_rules(spark):
    nodes = parse('<main><section class="s"><h2>One</h2><ul><li><a href="/1">First</a><time>3h</time></li><li><a href="/2">Second</a></li></ul></section></main>')
    tree = rules.compile_selectors({"Sections": "section.s[]", "Sections.name": "h2", "Sections.items": "li[]", "Sections.items.text": "a", "Sections.items.time": "time", "None": "em", "Attr": "a@href"})
    got = rules.extract(nodes, tree)
    assert got["Sections"][0]["name"] == "One" and [i["href"] for i in got["Sections"][0]["items"]] == ["/1", "/2"] and "None" not in got and got["Attr"] == "/1"
    assert {"text": "First", "href": "/1"} in rules.collect_links(got)
    assert spark.createDataFrame([], rules.output_type(tree)).schema["Sections"].dataType.typeName() == "array"
    items = spark.createDataFrame([(1, "A long enough title", "/x"), (1, "x", "")], "page_id int, title string, href string")
    q = rules.item_quality(items).first()
    assert (q["items"], q.link_ratio, q.good_ratio) == (2, 0.5, 0.5)
    assert not rules.page_type_matches(rules.PageType({}), "u", nodes) and rules.page_type_matches(rules.PageType({}, has_selector="li"), "u", nodes) and not rules.page_type_matches(rules.PageType({}, url_pattern="("), "u", nodes)


def test_links(spark):
    bad = ["+1", "tel:1", "\\x.com", "nodot", "a.b", "x.blogspot.de", "WWW.x.tumblr.com", "facebook.com", "maps.google.com", "bit.ly", "spam.click", "a.top", "averyveryverylongname.xyz", "ñ.com", "%x" + "y" * 90]
    good = ["example.com", "short.xyz", "my.desktop.top", None]
    df = spark.createDataFrame([(x,) for x in bad + good], "to_domain string")
    assert {r.to_domain for r in links.clean_links(df).collect()} == set(good)
    report = links.clean_up_report(df).first()
    assert (report.before, report.after) == (len(bad + good), len(good))
    why = spark.createDataFrame([("Just a moment...",), ("recaptcha",), ("recaptcha" + "x" * 20000,), ("ok",)], "h string").select(links.blocked_reason(F.col("h")).alias("r")).collect()
    assert [r.r for r in why] == ["Cloudflare challenge", "reCAPTCHA challenge", "", ""]
    q = spark.createDataFrame([("a", 1, 0, "s")], "url string, priority int, depth int, found_from string")
    assert links.enqueue(q, q.unionAll(spark.createDataFrame([("b", 2, 1, "s"), ("b", 1, 1, "t")], q.schema))).count() == 2


def test_search(spark):
    page = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2F1">A</a><a class="result__snippet">s</a></div><div class="result"><a class="result__a" href="https://a.com/1">A again</a></div>'
    got = search.html_results(spark.createDataFrame([("q", page)], "query string, html string"), "duckduckgo").collect()
    assert [(r.rank, r.title, r.url, r.domain) for r in got] == [(1, "A", "https://a.com/1", "a.com")]
    body = json.dumps({"hits": [{"objectID": "7", "title": "T", "points": 3, "num_comments": 2, "author": "u"}]})
    got = search.json_results(spark.createDataFrame([("q", body), ("r", "bad")], "query string, body string"), "hackernews").collect()
    assert [(r.query, r.url) for r in got] == [("q", "https://news.ycombinator.com/item?id=7")]
    assert "<h1>q</h1>" in search.results_page(search.json_results(spark.createDataFrame([("q", body)], "query string, body string"), "hackernews")).first().html
    thread = '<table><tr class="athing comtr" id="1"><td class="ind" indent="0"></td><td><a class="hnuser">u</a><span class="age">1h</span><div class="commtext">Hi <i>there</i><p>two <a href="http://x">l</a></div></td></tr><tr class="athing comtr" id="2"><td class="ind" indent="1"></td><td><div class="commtext">re</div></td></tr></table>'
    got = search.comments_of(spark.createDataFrame([(1, thread)], "page_id int, html string")).orderBy("ord").collect()
    assert [(r.id, r.indent, r.parent, r.text) for r in got] == [("1", 0, None, "Hi _there_\n\ntwo l [http://x]"), ("2", 1, "1", "re")]
    front = '<table><tr class="athing"><td><span class="rank">1.</span></td><td><span class="titleline"><a href="item?id=3">S</a></span></td></tr><tr><td><span class="score">9 points</span><a class="hnuser">z</a><a>4 comments</a></td></tr></table>'
    s = search.stories_of(spark.createDataFrame([(1, front)], "page_id int, html string")).first()
    assert (s.rank, s.title, s.points, s.author, s.comments, s.href) == (1, "S", 9, "z", 4, "https://news.ycombinator.com/item?id=3")


def test_document(spark):
    heads = spark.createDataFrame([(1, k, level) for k, level in enumerate([2, 1, 2, 3, 3, 2, 3, 1, 3])], "page_id int, ord int, level int")
    assert [r.number for r in document.section_numbers(heads).orderBy("ord").collect()] == ["1.", "1.", "1.1", "1.1.1", "1.1.2", "1.2", "1.2.1", "2.", None]
    spans = spark.createDataFrame([(1, 0, "/a", "x"), (1, 1, "/a", "y"), (1, 2, "", "-"), (1, 3, "/a", "z")], "page_id int, ord int, href string, text string")
    assert [r.text for r in document.link_runs(spans).orderBy("run").collect()] == ["xy", "z"]
    assert document.jump_labels(2) == ["a", "b"] and len(set(document.jump_labels(100))) == 100
    e = inspect.inspect(spark.createDataFrame([(1, PAGE)], "page_id int, html string"))
    assert {r.tag: r.shown for r in e.collect()}["nav"] is False and inspect.visible_blocks(e).where("tag = 'p'").count() == 1


def test_rule_records_of_all_hosts(spark, tmp_path):
    from weftlake.plans import catalog

    page = "<nav><li><a href='/x'>x</a></li></nav><article><h1>Title {0}</h1></article>"
    rows = [(k, f"http://www.h{k % 3}.com/{k}", page.format(k)) for k in range(7)]
    spark.createDataFrame(rows, "page_id int, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in catalog.rule_records(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in got.items()} == {k: f"Title {k}: 1" for k in range(7)}
    assert '"_domain": "h2.com"' in got[2].record


def test_story_text_and_scores(spark):
    story = {"title": "T", "href": "https://x.org/1", "description": "D", "author": "A", "date": "Jan 2, 2024", "source": "x.org"}
    assert content.story_text(story) == "T (x.org)\n  D\n  A · Jan 2, 2024" and content.story_text(story | {"source": "", "description": "", "author": "", "date": ""}) == "T"
    found = spark.createDataFrame([([("a story", "/1")] * 4, "x" * 200, ["ul > li", "div:nth-child(2) a"])], "links array<struct<text:string,href:string>>, text string, selectors array<string>")
    plain, judged = found.select(scoring.record_score(F.col("links"), F.col("text")).alias("p"), scoring.record_score(F.col("links"), F.col("text"), F.col("selectors")).alias("j")).first()
    assert judged.score == plain.score - 5 and judged.issues == ["position"]


def test_structured_text(spark):
    page = "<article><h1>Head</h1><p>One <b>bold</b></p><blockquote><p>Said</p></blockquote><ul><li>x</li></ul></article>"
    got = {r.page_id: r.text for r in content.structured_text(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()}
    assert got[1].split("\n\n") == ["Head", "One bold", "Said", "x"] and got[2] == ""


def test_host_rules_by_brute_force(spark):
    """The rules by labels against patterns held against whole hosts."""
    import fnmatch
    import random

    rng = random.Random(2)
    words = ["google", "amazon", "tumblr", "com", "org", "desktop", "top", "xyz", "softonic", "a", "", "GOOGLE", "listal", "blogspot", "livejournal", "click", "co", "uk", "apple"]
    hosts = [".".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(800)] + ["x" * 90, "é.com", "notlivejournal.com", "a.livejournal.com."]
    like = lambda h, patterns: any(fnmatch.fnmatchcase(h.lower(), p.replace("%", "*")) for p in patterns)
    lists = {"spam": links.SPAM_HOSTS, "blog": links.BLOG_HOSTS, "download": links.DOWNLOAD_HOSTS, "other": links.OTHER_HOSTS, "big": links.BIG_HOSTS}
    df = spark.createDataFrame([(h,) for h in hosts], "d string")
    rows = df.select("d", *[r.alias(n) for n, r in links.link_rules(F.col("d")).items()]).collect()
    for r in rows:
        h = r.d
        for name, patterns in lists.items():
            assert r[name] == like(h, patterns), (h, name)
        ending = any(h.lower().endswith(e) for e in links.SPAM_ENDINGS) or (h.lower().endswith(".top") and not like(h, ["%.desktop.%"])) or (h.lower().endswith(".xyz") and len(h) > 20)
        assert r.ending == ending, h


def test_parents_of_comments():
    rng = __import__("random").Random(5)
    comments = [{"id": str(k), "indent": rng.randint(0, 5)} for k in range(300)]
    for k, c in enumerate(search.with_parents(comments)):
        before = [o for o in comments[:k] if o["indent"] < c["indent"]]
        assert c["parent"] == (before[-1]["id"] if before else None)
