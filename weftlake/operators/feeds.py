"""Feed state as DataFrames: upserts, unread items, retention, expiry and read marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions.values import item_date, relative_time

#: Items kept of each feed, and days for which a read mark lasts.
KEPT_ITEMS, MARK_DAYS = 100, 30


def newest_first(items: DataFrame) -> DataFrame:
    """All items by time, newest first; unknown times last, ties by feed and guid."""
    return items.orderBy(F.col("published").desc_nulls_last(), "feed_url", "guid")


def newest(items: DataFrame, n: int = KEPT_ITEMS) -> DataFrame:
    """The newest n items of each feed; 0 keeps all."""
    if n <= 0:
        return items
    w = W.Window.partitionBy("feed_url").orderBy(F.col("published").desc_nulls_last(), "guid")
    return items.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def unread(items: DataFrame, reads: DataFrame) -> DataFrame:
    """Items whose guid, of any feed, is not marked."""
    return items.join(reads.select("guid"), "guid", "left_anti").select(*items.columns)


def read_items(items: DataFrame, reads: DataFrame) -> DataFrame:
    return items.join(reads.select("guid"), "guid", "left_semi").select(*items.columns)


def unread_counts(items: DataFrame, reads: DataFrame) -> DataFrame:
    """(feed_url, unread) of every feed that has items."""
    marked = items.join(reads.select("guid", F.lit(1).alias("__read")).dropDuplicates(["guid"]), "guid", "left")
    return marked.groupBy("feed_url").agg(F.count_if(F.col("__read").isNull()).alias("unread"))


def live_marks(reads: DataFrame, now: Column, days: int = MARK_DAYS) -> DataFrame:
    return reads.where(F.col("read_at") >= now - F.expr(f"interval {days} days"))


def mark_by_link(items: DataFrame, link: str, now: Column) -> DataFrame:
    """The read mark of the first item, by feed and guid, that has the link."""
    return items.where(F.col("link") == link).orderBy("feed_url", "guid").limit(1).select("guid", now.alias("read_at"))


def fold_marks(events: DataFrame) -> DataFrame:
    """Read marks after a log of (guid, op, at), op read or unread: the last one counts, at equal times the read."""
    last = events.groupBy("guid").agg(F.max(F.struct("at", F.when(F.col("op") == "read", 1).otherwise(0).alias("read"))).alias("last"))
    return last.where("last.read = 1").select("guid", F.col("last.at").alias("read_at"))


def upsert(items: DataFrame, incoming: DataFrame, n: int = KEPT_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(items after a poll, (feed_url, added)): what is not stored yet comes in, then the newest n stay.

    Items of the batch are not compared with each other. One that had been evicted counts as new again.
    """
    keys = ["feed_url", "guid"]
    new = incoming.join(items.select(*keys), keys, "left_anti").select(*items.columns)
    return newest(items.unionByName(new), n), new.groupBy("feed_url").agg(F.count("*").alias("added"))


def merge_feeds(feeds: DataFrame, imported: DataFrame) -> DataFrame:
    """Subscriptions with imported ones added; urls are compared without case, also within the import, first by title."""
    w = W.Window.partitionBy("__key").orderBy("title", "url")
    new = imported.withColumn("__key", F.lower("url")).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    new = new.join(feeds.select(F.lower("url").alias("__key")), "__key", "left_anti")
    return feeds.unionByName(new.select(*[c for c in feeds.columns if c in imported.columns]), allowMissingColumns=True)


def with_metadata(feeds: DataFrame, polled: DataFrame) -> DataFrame:
    """Feeds with what polls have told: texts that are not empty overwrite, of several polls of a feed the last; its error is that of the last poll.
    polled: url, title, description, site_url, fetched_at, error; a poll in error tells no texts."""
    last = lambda c, when=None: F.max_by(c, F.when(when, F.col("fetched_at")) if when is not None else F.col("fetched_at")).alias(f"__{c}")
    told = lambda c: last(c, (F.coalesce("error", F.lit("")) == "") & (F.coalesce(c, F.lit("")) != ""))
    p = polled.groupBy(F.col("url").alias("__url")).agg(told("title"), told("description"), told("site_url"), last("error"), F.max("fetched_at").alias("__fetched_at"))
    new = lambda c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)).alias(c)
    return feeds.join(p, F.col("url") == F.col("__url"), "left").select(
        "url", new("title"), new("description"), new("site_url"), "category", F.coalesce("__fetched_at", "last_fetch").alias("last_fetch"), F.when(F.col("__url").isNull(), F.col("fetch_error")).otherwise(F.coalesce("__error", F.lit(""))).alias("fetch_error")
    )


def item_page(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows of an item list: feed title, title, link, day and author, and at most 150 bytes of description."""
    from weftlake.functions.text import byte_prefix

    titled = items.join(feeds.select(F.col("url").alias("feed_url"), F.col("title").alias("feed_title")), "feed_url", "left")
    text = F.when(F.octet_length("description") > 150, F.concat(byte_prefix(F.col("description"), 147), F.lit("..."))).otherwise(F.col("description"))
    return titled.select("feed_url", "guid", F.coalesce("feed_title", F.lit("")).alias("feed_title"), "title", "link", item_date(F.col("published"), F.col("author")).alias("byline"), text.alias("description"))


def feed_page(feeds: DataFrame, items: DataFrame, reads: DataFrame, now: Column) -> DataFrame:
    """Rows of a feed list: unread and all items, and how long ago each was fetched."""
    counts = unread_counts(items, reads).join(items.groupBy("feed_url").agg(F.count("*").alias("n_items")), "feed_url")
    rows = feeds.join(counts, feeds.url == counts.feed_url, "left")
    return rows.select("url", "title", "category", F.coalesce("unread", F.lit(0)).alias("unread"), F.coalesce("n_items", F.lit(0)).alias("items"), relative_time(F.col("last_fetch"), now).alias("fetched"), "fetch_error")
