"""What a task holds of the pages that it parses, and reading stories in linear time."""

import sys

import pyarrow as pa
from pyspark.sql import types as T

from weftlake.functions import dom
from weftlake.functions.dom import parse
from weftlake.operators import content, search
from weftlake.sources import feeds as sources


class Frame:
    """Stands for a frame of pages, so that the function of a task can be called."""

    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType())])

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_pages_are_handed_on_as_they_are_made(spark):
    pages = ["<body>" + f"<p>{k}</p>" * 200 + "</body>" for k in range(500)] + [None, "<div>" * 900]
    run = content.page_parts(Frame(), ["content", "lang"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), pa.array(pages)], ["page_id", "html"])
    out = list(run([batch, batch.slice(0, 0)]))
    assert max(sum(len(v or []) for v in b["content"].to_pylist()) for b in out) <= content.HELD // content.HELD_ITEM + 400  # not 200,000 at once
    table = pa.Table.from_batches(out)
    assert table["page_id"].to_pylist() == list(range(len(pages)))
    assert table["parse_error"].to_pylist() == [False] * 501 + [True]
    assert [v[0]["text"] for v in table["content"].to_pylist()[:500]] == [str(k) for k in range(500)]


def test_stories_do_not_list_all_rows(monkeypatch):
    row = '<tr class="athing"><td><span class="titleline"><a href="item?id={0}">T{0}</a></span></td></tr><tr><td><span class="score">{0} points</span><a>1 comment</a></td></tr>'
    nodes = parse("<table>" + "".join(row.format(k) for k in range(50)) + "</table>")
    monkeypatch.setattr(search, "children", lambda *_: (_ for _ in ()).throw(AssertionError("the rows of the whole table, for one story")))
    assert [(s["title"], s["points"], s["comments"]) for s in search.discussion_stories(nodes)] == [(f"T{k}", k, 1) for k in range(50)]


def test_calls_of_a_story_page():
    """Reading a page of stories makes a bounded number of calls for each: nodes are not looked at anew for each kind of root, nor equal attributes read twice."""
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    row = '<tr class="athing"><td><span class="rank">1.</span></td><td><span class="titleline"><a href="https://a.com/{0}">click</a></span></td></tr><tr><td><span class="score">{0} points</span> by <a class="hnuser">me</a> <a>3 comments</a></td></tr>'
    page = "<table>" + "".join(row.format(k) for k in range(200)) + "</table>"
    sys.setprofile(count)
    try:
        nodes = dom.parse(page)
        got = content.content_nodes(nodes, content.content_root(nodes))
    finally:
        sys.setprofile(None)
    assert len(got) == 400 and got[2]["text"] == "click (1 points, 3 comments)"
    assert calls < 500 * 200  # 659 a story when each kind had its own look


def test_roots_by_role_and_id():
    """The order of kinds decides, not the order on the page."""
    marked = ['<div id="main">a</div>', '<section id="main-content">b</section>', '<td id="content">c</td><div id="content">c</div>', '<span role="main">d</span>', "<article>e</article>"]
    for k in range(len(marked)):
        nodes = dom.parse("<body><p>x</p><p id='content'>y</p><table><tr>" + "".join(marked[: k + 1]) + "</table>")
        assert dom.text_of(nodes, content.content_root(nodes)) == "abcde"[k]


def test_opml_is_handed_on(spark):
    """A task reads one text at a time: what it hands on is bounded, in order, and a batch's bytes are bounded too."""

    class Bodies:
        schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("body", T.StringType())])
        sparkSession = spark  # noqa: N815

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    def text(n):
        return '<opml><body><outline text="A">' + "".join(f'<outline title="t{k}" xmlUrl="u{k}"/>' for k in range(n)) + "</outline></body></opml>"

    frame, sizes, read = Bodies(), [3, 0, 5000, 2048, 1, 2047], []
    bodies = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(8)]), pa.array([*map(text, sizes), None, "<bad"])], ["path", "body"])
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        sources.opml_feeds(frame)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    for made in frame.run(iter([bodies, bodies])):
        assert 0 < made.num_rows <= sources.ROWS
        read += made.to_pylist()
    want = [{"path": f"p{k}", "ord": j, "url": f"u{j}", "title": f"t{j}", "site_url": "", "category": "A"} for k, n in enumerate(sizes) for j in range(n)]
    assert read == want + want
