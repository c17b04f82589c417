"""The store of rows by key: versions, touched buckets, dead and repeated changes; the poller over it."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftlake.operators import feeds
from weftlake.sources import files, keyed
from weftlake.streaming import feeds as stream

SCHEMA = "k string, v long"


def put(rows, new):
    """New rows replace those of their key."""
    return rows.join(new, "k", "left_anti").unionByName(new)


def table(df):
    return {r.k: r.v for r in df.collect()}


def test_versions(spark, tmp_path):
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 16)
    assert store.read().count() == 0 and store.versions() == [] and store.vacuum() == []
    rows = lambda pairs: spark.createDataFrame(pairs, SCHEMA)
    first = store.change(rows([(f"k{i}", i) for i in range(2000)]), put)
    whole = files.size(spark, f"{tmp_path}/s/data")
    second = store.change(rows([("k7", 70), ("k7b", 71)]), put)
    assert len(first["buckets"]) == 16 and sum(first["buckets"][b] != f for b, f in second["buckets"].items()) in (1, 2)
    assert files.size(spark, f"{tmp_path}/s/data") - whole < whole / 5  # what a change writes follows the change
    now = table(store.read())
    assert now["k7"] == 70 and now["k7b"] == 71 and len(now) == 2001 and table(store.read(1)) == {f"k{i}": i for i in range(2000)}
    assert table(store.lookup(rows([("k7", 0), ("none", 0)]))) == {"k7": 70}
    assert keyed.KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 99).buckets == 16  # a store keeps its number of buckets
    store.change(rows([]), put)
    third = store.change(rows([(None, 5), ("k7", 1)]), lambda old, new: old.where("k is null or k <> 'k7'").unionByName(new.where("k is null")))
    assert "k7" not in table(store.read()) and table(store.read())[None] == 5 and third["version"] == 4
    gone = store.vacuum(keep=1)
    assert store.versions() == [4] and gone and len(table(store.read())) == 2001
    with pytest.raises(Exception):  # noqa: B017  an older version went
        store.read(1)


def test_dead_and_repeated_changes(spark, tmp_path, monkeypatch):
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 4)
    rows = lambda pairs: spark.createDataFrame(pairs, SCHEMA)
    store.change(rows([("a", 1), ("b", 1)]), put, batch=0)

    def dies(rows_, new):
        return put(rows_, new).withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        store.change(rows([("a", 2), ("c", 2)]), dies, batch=1)
    assert table(store.read()) == {"a": 1, "b": 1}
    # killed between data and manifest
    monkeypatch.setattr(files, "write_new", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.change(rows([("a", 2), ("c", 2)]), put, batch=1)
    monkeypatch.undo()
    assert table(store.read()) == {"a": 1, "b": 1} and store.versions() == [1]
    store.change(rows([("a", 2), ("c", 2)]), put, batch=1)
    again = store.change(rows([("a", 3)]), put, batch=1)  # the stream repeats its last batch
    assert again["version"] == 2 and table(store.read()) == {"a": 2, "b": 1, "c": 2}
    assert len(store.vacuum(keep=1)) >= 2 and table(store.read()) == {"a": 2, "b": 1, "c": 2}
    # two writers of one version
    made = files.write_new(spark, f"{tmp_path}/s/manifests/{3:012d}.json", json.dumps(store.manifest() | {"version": 3}))
    assert made and not files.write_new(spark, f"{tmp_path}/s/manifests/{3:012d}.json", "{}")
    monkeypatch.setattr(keyed.KeyedStore, "manifest", lambda self, version=None, old=store.manifest(2): old)
    with pytest.raises(keyed.Conflict):
        store.change(rows([("d", 1)]), put)


def poll(url, at, items, error=""):
    body = '<rss version="2.0"><channel><title>T</title>' + "".join(f"<item><title>{t}</title><guid>{g}</guid><pubDate>Mon, 01 Jan 2024 00:00:{s:02d} +0000</pubDate></item>" for g, t, s in items) + "</channel></rss>"
    return json.dumps({"feed_url": url, "fetched_at": at, "body": body, "error": error})


def test_polls_of_one_batch(spark, tmp_path):
    """Three polls with one guid in a batch leave one item, the first; a batch that is run again is applied once."""
    folder, table_, ck = (str(tmp_path / x) for x in ("in", "items", "ck"))
    (tmp_path / "in").mkdir()
    at = "2024-01-01T00:0{0}:00"
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join([poll("f", at.format(k), [("g", f"title {k}", 1), (f"own{k}", "x", 2)]), poll("h", at.format(k), [("g", "other", 1)]), poll("e", at.format(k), [("g", "x", 1)], "timeout")]))
    counts = {}
    run = lambda: stream.poll_batches(stream.read_polls(spark, folder, 3), table_, ck, 100, lambda d, n: counts.__setitem__(n, {r.feed_url: r.added for r in d.collect()})).awaitTermination()
    run()
    got = sorted((r.feed_url, r.guid, r.title) for r in stream.stored_items(spark, table_).collect())
    assert got == [("f", "g", "title 0"), ("f", "own0", "x"), ("f", "own1", "x"), ("f", "own2", "x"), ("h", "g", "other")] and counts == {0: {"f": 4, "h": 1}}
    (tmp_path / "ck" / "commits" / "0").unlink()  # as if the stream had died before it noted the batch
    (tmp_path / "ck" / "commits" / ".0.crc").unlink(missing_ok=True)
    run()
    assert sorted((r.feed_url, r.guid, r.title) for r in stream.stored_items(spark, table_).collect()) == got and list(counts) == [0]
    (tmp_path / "in" / "9.json").write_text(poll("h", at.format(9), [("new", "n", 5)]))
    run()
    assert stream.stored_items(spark, table_).count() == 6 and stream.item_store(spark, table_).versions() == [1, 2] and stream.stored_items(spark, table_, 1).count() == 5


def test_metadata_of_several_polls(spark):
    now = dt.datetime(2024, 1, 1)
    feeds_ = spark.createDataFrame([("f", "old", "", "s", "c", None, "was bad"), ("g", "G", "", "", "c", None, "")], "url string, title string, description string, site_url string, category string, last_fetch timestamp, fetch_error string")
    polled = spark.createDataFrame([("f", "one", "d", "", now, ""), ("f", "two", "", None, now + dt.timedelta(1), ""), ("f", "no", "", "", now + dt.timedelta(2), "timeout")], "url string, title string, description string, site_url string, fetched_at timestamp, error string")
    got = {r.url: r for r in feeds.with_metadata(feeds_, polled).collect()}
    assert len(got) == 2 and (got["f"].title, got["f"].description, got["f"].site_url, got["f"].fetch_error) == ("two", "d", "s", "timeout") and got["f"].last_fetch == now + dt.timedelta(2) and got["g"].title == "G"
