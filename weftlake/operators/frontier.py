"""The crawl frontier: urls seen so far in buckets with a Bloom sketch each, an exact check of what the sketches let through, and turns per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.operators.links import first_by
from weftlake.sources.keyed import KeyedStore

URL = "url string, host string, priority int, depth int, found_from string, batch long"
SKETCH = "sketch_bucket int, bits array<long>"
#: Bits of a bucket's sketch, in words of 64, and the number of them that a url sets.
WORDS, HASHES = 4096, 5


def _bit(url: Column, k: int, words: int) -> Column:
    """The k-th bit of a url."""
    return F.pmod(F.xxhash64(url, F.lit(k)), F.lit(64 * words))


class Frontier:
    """Urls that were ever enqueued, kept by url in a store with a version for each batch, and beside it a Bloom filter for each bucket.

    A batch of found urls meets the filters first, a broadcast of a known size (buckets x words). What they have never seen is new without further ado; only what they may have seen is looked up, and the store opens the
    buckets of those urls only. A filter never forgets, so no url is taken for new twice; a url that it mistakes costs a look-up, not a loss.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, words: int = WORDS):
        self.spark, self.words = spark, words
        self.seen = KeyedStore(spark, f"{root}/seen", URL, ["url"], buckets)
        self.sketches = KeyedStore(spark, f"{root}/sketches", SKETCH, ["sketch_bucket"], 1)

    def _bucket(self) -> Column:
        return self.seen.bucket(F.col("url"))

    def sift(self, found: DataFrame) -> DataFrame:
        """found with maybe: whether the bucket's filter holds all bits of the url."""
        sketches = self.sketches.read()
        rows = found.withColumn("sketch_bucket", self._bucket())
        for k in range(HASHES):
            rows = rows.withColumn(f"bit{k}", _bit(F.col("url"), k, self.words))
        held = F.expr(" and ".join(f"(shiftrightunsigned(get(bits, cast(bit{k} div 64 as int)), cast(bit{k} % 64 as int)) & 1) = 1" for k in range(HASHES)))
        # buckets * words * 8 bytes, whatever the number of urls
        return rows.join(F.broadcast(sketches), "sketch_bucket", "left").withColumn("maybe", F.coalesce(held, F.lit(False))).drop("bits", "sketch_bucket", *[f"bit{k}" for k in range(HASHES)])

    def _merged(self, new: DataFrame) -> DataFrame:
        """(sketch_bucket, bits): the filters of new urls alone; bits are set word by word before a bucket's words meet."""
        bits = F.array(*[_bit(F.col("url"), k, self.words) for k in range(HASHES)])
        each = new.select(self._bucket().alias("sketch_bucket"), F.explode(bits).alias("bit")).select("sketch_bucket", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
        words = each.groupBy("sketch_bucket", "word").agg(F.bit_or("mask").alias("mask"))
        return _arrays(words.groupBy("sketch_bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("set")), self.words)

    def enqueue(self, found: DataFrame, batch: int) -> DataFrame:
        """Adds what was not seen before and returns it; of repeated urls the first by priority, depth and source. A batch that was applied already returns what it added then.

        found: url, host, priority, depth, found_from. The urls go in before their sketches; should the sketches be missing after a failure, the repeated batch mends them.
        """
        applied = self.seen.manifest()["batch"]
        if applied is None or applied < batch:
            first = first_by(found.where("url is not null"), ["url"], "priority", "depth", "found_from").withColumn("batch", F.lit(batch).cast("long")).select("url", "host", "priority", "depth", "found_from", "batch")
            sifted = self.sift(first).persist()
            try:
                maybe = sifted.where("maybe")
                known = self.seen.lookup(maybe.select("url")).select("url")
                new = sifted.where("not maybe").unionByName(maybe.join(known, "url", "left_anti")).drop("maybe")
                self.seen.change(new, lambda old, more: old.unionByName(more), batch)
            finally:
                sifted.unpersist()
        added = self.seen.read().where(F.col("batch") == batch)
        sketched = self.sketches.manifest()["batch"]
        if sketched is None or sketched < batch:
            self.sketches.change(self._merged(added), self._or, batch)
        return added

    def _or(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.join(new.withColumnRenamed("bits", "more"), "sketch_bucket", "full")
        bits = F.when(F.col("bits").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("bits")).otherwise(F.zip_with("bits", "more", lambda a, b: a.bitwiseOR(b)))
        return both.select("sketch_bucket", bits.alias("bits"))


def _arrays(sets: DataFrame, words: int) -> DataFrame:
    return sets.select("sketch_bucket", F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.coalesce(F.try_element_at("set", k), F.lit(0).cast("long"))).alias("bits"))


def turns(queue: DataFrame, most: int) -> DataFrame:
    """(turn, ...): the queue dealt into turns of at most one url of a host, by priority, depth and url within the host; the first `most` turns. Hosts with many urls wait, no host is left behind."""
    w = W.Window.partitionBy("host").orderBy("priority", "depth", "url")
    return queue.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)


def enqueue_links(frontier: Frontier, links: DataFrame, batch: int, priority: Column, source: str) -> DataFrame:
    """Enqueues links(href, depth) that lead to hosts, by their resolved urls."""
    host = F.lower(F.regexp_extract("href", r"^https?://([^/?#]+)", 1))
    rows = links.withColumn("host", host).where("host <> ''").select(F.col("href").alias("url"), "host", priority.cast("int").alias("priority"), F.col("depth").cast("int").alias("depth"), F.lit(source).alias("found_from"))
    return frontier.enqueue(rows, batch)
