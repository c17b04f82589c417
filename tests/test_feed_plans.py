"""How often a feed's body is parsed, and feeds that are captured in pages."""

from weftlake.sources import feeds as sources


def test_bodies_are_parsed_once(spark):
    body = "<rss><channel><title>T</title><item><guid>1</guid></item></channel></rss>"
    bodies = spark.createDataFrame([("a", body), ("b", "no feed"), ("c", "<rss><channel><title>T</title></channel></rss>")], "feed_url string, body string")
    items = sources.feed_items(sources.parse_feeds(bodies))
    assert items._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") <= 3  # one for each kind of feed
    assert [(r.feed_url, r.ord, r.guid) for r in items.collect()] == [("a", 0, "1")]


def test_feeds_in_pages(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from weftlake.plans import answers
    from weftlake.sources import archive

    monkeypatch.setattr(answers, "_PAGE", 20)
    monkeypatch.setattr(answers, "shared_folder", lambda _: str(tmp_path / "shared"))
    spark.range(100).selectExpr("id as event_id", "if(id % 2 = 0, 'view', 'click') as event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["feed_polls_from_archive"](spark, str(tmp_path)).collect()
    assert sorted((r.feed_url, int(r.guid), r.title) for r in got) == sorted((f"https://f.org/{t}", k, t) for k in range(100) for t in [("view", "click")[k % 2]])
    captured = spark.read.format("webarchive").load(str(next((tmp_path / "shared").glob("captured-*"))) + "/responses").collect()
    assert max(r.body.count("<item>") for r in captured) <= 20  # no document has a whole feed
    reader = archive.PollReader({"feeds": "", "responses": str(next((tmp_path / "shared").glob("captured-*"))) + "/responses", "pages": "page"})
    tasks = [list(reader.read(archive.Feeds(["https://f.org/view", "https://f.org/none"], 3600.0, k, 4))) for k in range(4)]
    rows = [r for t in tasks for r in t]
    assert len([r for r in rows if r[0] == "https://f.org/view" and r[3] == ""]) == 5 and len([r for r in rows if r[3] == "no response"]) == 1
    assert max(map(len, tasks)) < len(rows)
