"""Stored state, scoring and rendering on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from weftlake.operators import render, scoring
from weftlake.sources import state


def test_state(spark, tmp_path):
    folder = str(tmp_path)
    assert state.load(spark, folder, "reads").count() == 0
    now = dt.datetime(2024, 3, 1)
    marks = spark.createDataFrame([("a", now - dt.timedelta(days=40)), ("b", now - dt.timedelta(days=3))], state.READ)
    state.save(marks, folder, "reads", F.lit(now))
    assert [r.guid for r in state.load(spark, folder, "reads").collect()] == ["b"]
    state.clear(spark, folder, "reads")
    assert state.load(spark, folder, "reads").count() == 0
    fav = spark.createDataFrame([("u", "t", now)], state.FAVOURITE)
    assert state.add_favourite(fav, spark.createDataFrame([("u", "x", now), ("v", "y", now), ("v", "z", now)], state.FAVOURITE)).count() == 2
    rule = lambda d, v: (d, v, "p", None, {"a": "b"}, "", True)
    state.save_rules(spark.createDataFrame([rule("a.com", 1), rule("b.com:80", 1)], state.RULE), f"{folder}/rules")
    state.save_rules(spark.createDataFrame([rule("a.com", 2)], state.RULE), f"{folder}/rules")
    assert {(r.domain, r.version) for r in state.load_rules(spark, f"{folder}/rules").collect()} == {("a.com", 2), ("b.com:80", 1)}
    assert state.load_config("[a]\nx = 2\ny = false\n", {"a": {"x": 1, "y": True}, "b": 3}) == {"a": {"x": 2, "y": True}, "b": 3}


def test_scoring(spark):
    link = "array<struct<text:string,href:string>>"
    rows = spark.createDataFrame([(1, [(f"Story {k}", "/") for k in range(5)], "x" * 200), (2, [(t, "/") for t in ("Home", "News", "Sport", "Menu")], "x"), (3, None, None)], f"i int, links {link}, text string")
    got = [r.s for r in rows.select("i", scoring.record_score(F.col("links"), F.col("text")).alias("s")).orderBy("i").collect()]
    assert (got[0].score, got[0].issues) == (100, []) and got[1].score == 20 and "menu entries" in got[1].issues and got[2].score == 0
    titles = spark.createDataFrame([("ab",), ("1. x",), ("Home",), ("Home page",)], "t string").select(scoring.is_bad_title(F.col("t")).alias("b")).collect()
    assert [r.b for r in titles] == [True, True, True, False]
    names = spark.createDataFrame([("bbc.com",), ("www.example.org",), ("localhost",)], "d string").select(scoring.site_title(F.col("d")).alias("t")).collect()
    assert [r.t for r in names] == ["BBC News", "Example", "localhost"]
    said = spark.createDataFrame([('Sure: {"skip": true, "reason": "fine"} ok',), ("no",), ('{"skip": false}',)], "a string").select(scoring.skip_answer(F.col("a")).alias("s")).collect()
    assert [(r.s.skip, r.s.reason) for r in said] == [(True, "fine"), (False, ""), (False, "")]
    items = spark.createDataFrame([(1, k, f"Title {k}", "/x" if k else "", "") for k in range(7)], "page_id int, ord int, title string, href string, metadata string")
    summary = scoring.extraction_summary(items).first().summary
    assert summary.startswith("Extracted 7 items\nItems with links: 6/7\n\nFirst 5 items:\n1. Title 0\n2. Title 1\n   → /x\n") and summary.endswith("... and 2 more\n")


def test_render(spark):
    page = "<title>T</title><body><main><h1>Head</h1><p>Some text here</p><ul><li>one</li></ul><table><tr><th>a<th>b<tr><td>1<td>2</table></main>"
    text = render.printed(spark.createDataFrame([(1, page)], "page_id int, html string"), 20).first().text
    assert "HEAD" in text and "• one" in text and "│ a   │ b   │" in text and text.endswith("┘\n") and all(len(x) <= 20 for x in text.split("\n"))
    nodes = render.template_nodes("**Top**\n\n• First story\n• [Second](/2) and\n\n────", [{"text": "First story", "href": "/1"}, {"text": "Second", "href": "/2"}])
    assert [n["type"] for n in nodes if n["parent"] == -1] == ["paragraph", "list", "hr"] and [n["href"] for n in nodes if n["type"] == "list_item"] == ["/1", "/2"]
    records = spark.createDataFrame([(1, "• a", [("a", "/a")])], "page_id int, text string, links array<struct<text:string,href:string>>")
    assert {r.type for r in render.record_documents(records).collect()} == {"list", "list_item", "text"}
    assert spark.range(1).select(render.text_to_html(F.lit("a<b\nc\n\n\n\nd")).alias("h")).first().h == "<p>a&lt;b<br>c</p>\n<p>d</p>\n"
