"""Captured responses written out and read back, filters on the host, and polls of feeds from them with replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftlake.sources import archive
from weftlake.streaming import feeds as stream

AT = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
ODD = [
    ("https://A.com:8080/x?y=1", AT, 200, "OK", {"Content-Type": "text/html; charset=iso-8859-1", "X": "a: b"}, "é\r\n\r\nbody"),
    ("https://b.a.com/", AT, 404, "Not Found", {}, ""),
    ("http://u:p@a.com/\nz", AT, 500, None, None, None),
    ("no url", AT, 200, "OK", {"Content-Type": "x; charset=none-such"}, "日本 \U0001f600"),
]


@pytest.fixture
def sources(spark):
    archive.register(spark)
    return spark


def frame(spark, rows):
    return spark.createDataFrame([(u, archive.host_name(u), a, s, r, h, b) for u, a, s, r, h, b in rows], archive.RESPONSE)


def test_round_trip(sources, tmp_path):
    spark, path = sources, str(tmp_path / "a")
    rows = [*ODD, *[(f"https://h{k % 40}.org/{k}", AT + dt.timedelta(seconds=k), 200, "OK", {"Content-Type": "text/html"}, f"<p>{k}</p>" * 20) for k in range(1000)]]
    frame(spark, rows).repartition(3).write.format("webarchive").mode("append").save(path)
    df = spark.read.format("webarchive").load(path)
    got = {r.url: r for r in df.collect()}
    assert len(got) == len(rows) and df.count() == len(rows)
    for u, a, s, r, h, b in rows:
        g = got[u.replace("\n", " ")]
        assert (g.status, g.reason, g.headers, g.body) == (s, r or "", h or {}, b or "") and g.fetched_at.replace(tzinfo=dt.UTC) == a
    assert got["https://A.com:8080/x?y=1"].host == "a.com" == got["http://u:p@a.com/ z"].host and got["no url"].host == ""
    small = spark.read.format("webarchive").option("split", 2000).load(path)
    assert small.count() == len(rows) and small.rdd.getNumPartitions() > 10
    frame(spark, rows[:4]).write.format("webarchive").mode("overwrite").save(path)
    assert spark.read.format("webarchive").load(path).count() == 4


def test_filters_open_fewer_records(sources, tmp_path, monkeypatch):
    spark, path = sources, str(tmp_path / "a")
    rows = [(f"https://h{k % 40}.org/{k}", AT, 200, "OK", {}, "x") for k in range(400)] + [("https://b.h1.org/", AT, 200, "OK", {}, "x")]
    frame(spark, rows).repartition(2).write.format("webarchive").mode("append").save(path)
    df = spark.read.format("webarchive").load(path)
    want = lambda cond: sorted(u for u, *_ in rows if cond(archive.host_name(u)))
    found = lambda d: sorted(r.url for r in d.collect())
    assert found(df.where("host = 'h1.org'")) == want(lambda h: h == "h1.org") and len(want(lambda h: h == "h1.org")) == 10
    assert found(df.where("host in ('h1.org', 'h2.org', 'none') and status = 200")) == want(lambda h: h in ("h1.org", "h2.org"))
    assert found(df.where("host = 'h1.org' and host in ('h2.org')")) == [] and found(df.where("host like '%h1.org'")) == want(lambda h: h.endswith("h1.org"))
    assert found(df.where("host is null")) == []
    opened = []
    monkeypatch.setattr(archive, "parse_record", lambda raw, real=archive.parse_record: opened.append(1) or real(raw))
    for filters, most in (([], 401), ([archive.EqualTo(("host",), "h1.org")], 10), ([archive.In(("host",), ("h1.org", "h3.org"))], 20)):
        reader = archive.ArchiveReader(path, archive.SPLIT)
        assert list(reader.pushFilters([*filters])) == []
        opened.clear()
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(opened) == most
    other = archive.EqualTo(("status",), 200)
    assert list(archive.ArchiveReader(path, 1).pushFilters([other])) == [other]


def test_failed_write_leaves_nothing(sources, tmp_path):
    spark, path = sources, str(tmp_path / "a")
    df = frame(spark, [(f"https://h.org/{k}", AT, 200, "OK", {}, "x") for k in range(10)])
    df.write.format("webarchive").mode("append").save(path)
    bad = df.repartition(2).withColumn("body", F.when(F.col("url").endswith("7"), F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("webarchive").mode("append").save(path)
    assert spark.read.format("webarchive").load(path).count() == 10


def rss(*guids):
    return '<rss version="2.0"><channel><title>T</title>' + "".join(f"<item><title>{g}</title><guid>{g}</guid></item>" for g in guids) + "</channel></rss>"


def test_polls(sources, tmp_path):
    spark = sources
    responses, requests, clock, feeds = (str(tmp_path / x) for x in ("r", "q", "clock", "feeds"))
    at = lambda s: dt.datetime.fromtimestamp(s, dt.UTC)
    rows = [("https://f.com/rss", at(3000), 200, "OK", {}, rss("a")), ("https://f.com/rss", at(4000), 200, "OK", {}, rss("b", "a")), ("https://f.com/rss", at(9000), 200, "OK", {}, rss("c"))]
    rows += [("https://g.com/rss", at(3000), 404, "Not Found", {}, ""), ("https://g.com/rss", at(3700), 200, "OK", {}, rss("g")), ("https://f.com/other", at(1), 200, "OK", {}, rss("no"))]
    frame(spark, rows).write.format("webarchive").mode("append").save(responses)
    (tmp_path / "feeds").write_text("https://f.com/rss\nhttps://g.com/rss\n\nhttps://f.com/rss\nhttps://none.com/\n")
    seen = []

    def run(now):
        (tmp_path / "clock").write_text(str(now))
        polls = spark.readStream.format("feedpolls").option("feeds", feeds).option("responses", responses).option("requests", requests).option("clock", clock).option("interval", 1800).load()
        seen.clear()
        polls.writeStream.foreachBatch(lambda d, n: seen.append((n, sorted((r.feed_url, int(r.fetched_at.replace(tzinfo=dt.UTC).timestamp()), r.body, r.error) for r in d.collect())))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return [(n, b) for n, b in seen if b]

    f, g, none = "https://f.com/rss", "https://g.com/rss", "https://none.com/"
    first = run(3650)  # the interval that began at 3600
    assert [b for _, b in first] == [[(f, 3600, rss("a"), ""), (g, 3600, None, "404 Not Found"), (none, 3600, None, "no response")]]
    assert run(3900) == []  # nothing is due
    for t in (4000.0, 4100.5, 4200.0):
        archive.ask(requests, t)
    asked = run(4300)  # three requests are one refresh
    assert [b for _, b in asked] == [[(f, 4200, rss("b", "a"), ""), (g, 4200, rss("g"), ""), (none, 4200, None, "no response")]]
    number = asked[0][0]
    for name in (str(number), f".{number}.crc"):  # as if the stream had died before it noted the batch; time has gone on
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    again = run(12_000) + run(12_000)
    assert again[0] == asked[0] and [b for _, b in again[1:]] == [[(f, 10_800, rss("c"), ""), (g, 10_800, rss("g"), ""), (none, 10_800, None, "no response")]]


def test_poller_over_the_source(sources, tmp_path):
    spark = sources
    frame(spark, [("https://f.com/rss", dt.datetime.fromtimestamp(10 + k, dt.UTC), 200, "OK", {}, rss(*[f"g{i}" for i in range(k + 1)])) for k in range(3)]).write.format("webarchive").mode("append").save(str(tmp_path / "r"))
    (tmp_path / "feeds").write_text("https://f.com/rss\n")
    for now, items in ((10, 1), (11, 2), (12, 3)):
        (tmp_path / "clock").write_text(str(now))
        polls = spark.readStream.format("feedpolls").option("feeds", str(tmp_path / "feeds")).option("responses", str(tmp_path / "r")).option("clock", str(tmp_path / "clock")).option("interval", 1).load()
        stream.poll_batches(polls, str(tmp_path / "items"), str(tmp_path / "ck")).awaitTermination()
        assert stream.stored_items(spark, str(tmp_path / "items")).count() == items
