"""Documents written by many tasks, and handlers as a table function."""

import random

import pytest
from pyspark.sql import functions as F

from weftlake.operators import handlers
from weftlake.sources import documents
from weftlake.sources import feeds as sources


def test_opml_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"https://f.org/{k}?a=1&b=<2>", rng.choice(["T & \"q\" 'x'", "b\nc", f"t{k}"]), rng.choice(["", None, "https://s.org"]), rng.choice(["", None, "News", "Tech & more", "z"])) for k in range(10_000)]
    feeds = spark.createDataFrame(rows, "url string, title string, site_url string, category string")
    path = str(tmp_path / "out" / "feeds.opml")
    documents.save_opml(feeds.repartition(7), path, "My <feeds>", "today")
    text = (tmp_path / "out" / "feeds.opml").read_text()
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["feeds.opml"] and "<title>My &lt;feeds&gt;</title>" in text and text.endswith("</opml>\n")
    want = sorted(((r[3] or "", r[1], r[0], r[2] or "") for r in rows))
    got = [(r["category"], r["title"], r["url"], r["site_url"]) for r in sources.read_opml(text)]
    assert got == want
    small = feeds.limit(50)
    documents.save_opml(small, path, "t")
    again = (tmp_path / "out" / "feeds.opml").read_text()
    assert sources.read_opml(again) == sources.read_opml(sources.write_opml(small.na.fill(""), "t"))


def test_failed_document(spark, tmp_path):
    path = str(tmp_path / "d.txt")
    lines = spark.range(100).select("id", F.col("id").cast("string").alias("line"))
    documents.save_lines(lines.where("id > 3"), path, ["id"], "head\n")
    assert (tmp_path / "d.txt").read_text() == "head\n" + "".join(f"{k}\n" for k in range(4, 100))
    bad = lines.withColumn("line", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        documents.save_lines(bad.repartition(4), path, ["id"])
    assert (tmp_path / "d.txt").read_text().startswith("head\n4\n")
    documents.save_lines(lines.limit(0), path, ["id"], "a", "b")
    assert (tmp_path / "d.txt").read_text() == "ab"


def test_handlers(spark):
    handlers.register(spark)
    front = '<table><tr class="athing"><td><span class="rank">1.</span><span class="titleline"><a href="item?id=3">S</a></span></tr><tr><td><span class="score">5 points</span></tr></table>'
    talk = '<table><tr class="athing comtr" id="c1"><td class="ind" indent="0"><td><div class="commtext">a</div></tr><tr class="athing comtr" id="c2"><td class="ind" indent="1"><td><div class="commtext">b</div></tr></table>'
    spark.createDataFrame([(1, front), (2, talk), (3, None), (4, "<div>" * 900), (5, '<link rel=alternate type=application/atom+xml href=/f><a href="/x">X</a>')], "page_id int, html string").createOrReplaceTempView("site_pages")
    sql = lambda handler, columns: [tuple(r) for r in spark.sql(f"select page_id, {columns} from site_pages, lateral site_rows(html, '{handler}') order by page_id, 2").collect()]
    assert sql("stories", "rank, title, points") == [(1, 1, "S", 5)]
    assert sql("comments", "id, parent, text") == [(2, "c1", None, "a"), (2, "c2", "c1", "b")]
    assert (5, "/x", "X") in sql("links", "href, text") and sql("feeds", "url") == [(5, "/f")] and sql("cells", "text") == []
    with pytest.raises(Exception, match="handler must be one of"):
        spark.sql("select * from site_pages, lateral site_rows(html, 'none')").collect()


def test_opml_by_many_tasks(spark, tmp_path):
    names = ["T & \"q\" 'x' > y", "b\nc", "ä"]
    rows = [(f"https://f.org/{k}?a=1&b=<2>", names[k % 3], "https://s.org" if k % 2 else "", ["", "News & more", "z"][k % 7 % 3]) for k in range(20_000)]
    path = str(tmp_path / "feeds.opml")
    documents.save_opml(spark.createDataFrame(rows, "url string, title string, site_url string, category string"), path, "My <feeds>")
    nested = tmp_path / "nested.opml"
    nested.write_text('<?xml version="1.0"?><opml><body><outline text="A"><outline title="B"><outline text="f" xmlUrl="u1"/></outline>\n<outline\n title="g" xmlUrl=\'u2\'><outline text="h" xmlUrl="u3"/></outline></outline><outline><outline xmlUrl="u4"/></outline></body></opml>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "100k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for file in (str(nested), *([path] if size == "100k" else [])):
                found = documents.opml_rows(spark, file)
                assert found.rdd.getNumPartitions() > 1 or size == "100k" and file != path  # no task has the whole file
                got = [r.asDict() for r in found.orderBy("ord").collect()]
                assert [g.pop("ord") for g in got] == list(range(len(got)))
                assert got == sources.read_opml(open(file).read())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_opml_export_reads_by_stretches(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(sources, "opml_feeds", lambda *a, **k: pytest.fail("the whole file in one row"))
    spark.range(50).selectExpr("id as event_id", "id % 3 as user_id", "'view' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["opml_export"](spark, str(tmp_path)).orderBy("ord").collect()
    assert len(got) == 50 and got == sorted(got, key=lambda r: (r.category, r.title, r.url))
