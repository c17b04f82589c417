"""The feed poller as a stream: files of fetched feeds in, stored items and new-item counts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.operators.feeds import KEPT_ITEMS, upsert
from weftlake.sources.feeds import feed_items, parse_feeds
from weftlake.sources.keyed import BUCKETS, KeyedStore

FETCHED = "feed_url string, fetched_at timestamp, body string, error string"
STORED = "feed_url string, guid string, title string, link string, description string, content string, author string, published timestamp"


def read_polls(spark: SparkSession, folder: str, files_per_batch: int = 3) -> DataFrame:
    """JSON lines of (feed_url, fetched_at, body, error), a few files at a time."""
    return spark.readStream.schema(FETCHED).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_of_polls(items: DataFrame) -> DataFrame:
    """Of items(feed_url, guid, fetched_at, poll, ord, ...) that several polls of a batch bring the first for each feed and guid: in order of the polls, then in the feed's order."""
    w = W.Window.partitionBy("feed_url", "guid").orderBy("fetched_at", "poll", "ord")
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def polled_items(batch: DataFrame) -> DataFrame:
    """(feed_url, guid, ..., fetched_at, poll): the items of a batch of polls without an error; each poll is parsed by itself."""
    good = batch.where(F.coalesce("error", F.lit("")) == "")
    polls = good.select(F.struct("feed_url", "fetched_at", F.xxhash64("body").alias("poll")).alias("key"), "body")
    items = feed_items(parse_feeds(polls, "key"), "key")
    return items.select("key.feed_url", *[c for c in items.columns if c != "key"], "key.fetched_at", "key.poll")


def item_store(spark: SparkSession, table: str, buckets: int = BUCKETS) -> KeyedStore:
    """The items of feeds, kept by feed_url."""
    return KeyedStore(spark, table, STORED, ["feed_url"], buckets)


def poll_batches(polls: DataFrame, table: str, checkpoint: str, n: int = KEPT_ITEMS, on_counts: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None):
    """Puts polls into the store of items at `table`: each micro-batch is parsed, and the feeds in it are upserted. Without a trigger all waiting polls are taken, then it stops.

    A batch rewrites the buckets of its feeds only. Its number is in the store's manifest, so a batch that is run again after a failure is applied once. Feeds in error
    change nothing. Of an item that several polls of a batch bring the first counts, as if they had come one by one.
    """
    store = item_store(polls.sparkSession, table)

    def step(batch: DataFrame, number: int) -> None:
        incoming = first_of_polls(polled_items(batch)).drop("fetched_at", "poll", "ord").persist()  # parsed once
        try:
            applied = store.manifest()["batch"]
            if on_counts and (applied is None or applied < number):  # from the version that the change starts from
                on_counts(upsert(store.lookup(incoming), incoming, n)[1], number)
            store.change(incoming, lambda items, new: upsert(items, new, n)[0], number)
        finally:
            incoming.unpersist()

    return polls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_items(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Items of the newest version, or of another one."""
    return item_store(spark, table).read(version)


def newest_state(items: DataFrame, n: int = KEPT_ITEMS) -> DataFrame:
    """(feed_url, new_items, kept) for each micro-batch of a stream of items: state per feed holds its newest n guids.

    Guids that fall out are forgotten and count as new when they come again, as in the batch upsert.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        kept = dict(zip(*state.get, strict=True)) if state.exists else {}
        before = set(kept)
        added = 0
        for pdf in batches:
            for guid, at in zip(pdf["guid"], pdf["published"].fillna(pd.Timestamp(0)), strict=True):
                if guid not in before:
                    added += 1
                    kept[guid] = at.value // 1000
        top = sorted(kept.items(), key=lambda x: (-x[1], x[0]))[: n if n > 0 else None]
        state.update(([g for g, _ in top], [a for _, a in top]))
        yield pd.DataFrame({"feed_url": [key[0]], "new_items": [added], "kept": [len(top)]})

    return items.groupBy("feed_url").applyInPandasWithState(step, "feed_url string, new_items long, kept long", "guids array<string>, ats array<long>", "update", GroupStateTimeout.NoTimeout)
