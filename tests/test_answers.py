"""Queries over written-out feeds, answers and pages against their SQL; page reading by site, rule and default."""

import os

import duckdb
import pytest

from weftlake.operators import reading, search
from weftlake.plans import answers

SF = "/root/testdata/sf0.001"
MADE = [n for n, f in answers.QUERIES.items() if f.__module__ == answers.__name__]


@pytest.mark.parametrize("name", MADE)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    want, got = con.sql(answers.SQL[name]), answers.QUERIES[name](spark, SF)
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    rows = lambda found: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in found)
    assert rows(got.select(*names).collect()) == rows(want.select(*[f'"{c}"' for c in names]).fetchall())


def test_read_pages(spark):
    front = '<table><tr class="athing"><td><span class="titleline"><a href="item?id=3">S</a></span></td></tr></table>'
    listed = "<body><ul>" + "".join(f"<li><a href='/{k}'>A story of some length {'xyz'[k]}</a></li>" for k in range(3)) + "</ul></body>"
    rows = [(1, "https://news.ycombinator.com/", front), (2, "https://www.a.com/1", listed), (3, "https://a.com/2", "<p>No list here</p>"), (4, "https://b.com/", listed), (5, "https://a.com/3", "<div>" * 700), (6, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    rules = spark.createDataFrame([("WWW.a.com", "ul", "li", "a", "list"), ("c.com", "", "", "", "")], "domain string, root string, articles string, title string, layout string")
    got = {r.page_id: r for r in reading.read_pages(pages, rules).collect()}
    assert {k: r.reader for k, r in got.items()} == {1: "site", 2: "rule", 3: "default", 4: "default", 5: "none", 6: "default"}
    assert [(e.text, e.href) for e in got[2].entries] == [(f"A story of some length {'xyz'[k]}", f"/{k}") for k in range(3)]
    assert got[1].entries[0].kind == "story" and got[3].entries[0].text == "No list here" and got[5].entries == []
    assert reading.read_pages(pages.limit(0), rules).count() == 0 and reading.read_pages(pages, rules.limit(0)).where("reader = 'rule'").count() == 0


def test_preview_of_any_host(spark):
    rows = [("https://github.com/a/b", '{"full_name":"a/b","description":"d"}'), ("https://x.org/", '<title>T &amp; U</title><meta property="og:site_name" content="X">'), (None, "<title>N</title>")]
    got = {r.url: r for r in search.preview_any(spark.createDataFrame(rows, "url string, body string")).collect()}
    assert (got["https://github.com/a/b"].title, got["https://x.org/"].title, got["https://x.org/"].site_name, got[None].title) == ("a/b", "T & U", "X", "N")
