"""Op 5 [native]: mix sources to target weights by drawing fixed-length blocks through index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.llm.common import Scratch, passing, small

#: Words in a block, blocks in an output shard, rounds of the index permutation and times it is taken at most.
BLOCK, SHARD, ROUNDS, WALK = 64, 1024, 8, 64
#: Shards whose counts are summed in one step, and documents of a source that one task puts in order.
SHARDS_TOGETHER, PER_BUCKET = 4096, 20_000
#: Slots that one task takes, as long as that makes no more than so many tasks.
SLOTS_EACH, MOST_PARTS = 100_000, 100_000
_SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_SPACE}]+")), F.lit(0)).cast("long")


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once: a plan would hold a copy of it for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grid(n: Column) -> tuple[Column, Column]:
    high = F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    return high, F.greatest(F.lit(1).cast("long"), F.ceil(n / high).cast("long"))


def _rounds(index: Column, n: Column, key: Column, order: list[int], sign: int) -> Column:
    """Rounds over the places of a grid of just over n, then again for a place beyond n until it is below. Fewer than ceil(sqrt(n)) places
    are beyond n, so WALK times always do for n up to WALK ** 2; above, a place stays beyond n each time by a chance under 1 / WALK."""

    def within(size: Column) -> Column:
        high, low = size["high"], size["low"]

        def turn(at: Column, r: Column) -> Column:
            row = F.when(r % 2 == 0, F.pmod(at["row"] + sign * F.pmod(F.xxhash64(key, r, at["col"]), high), high)).otherwise(at["row"])
            col = F.when(r % 2 == 1, F.pmod(at["col"] + sign * F.pmod(F.xxhash64(key, r, at["row"]), low), low)).otherwise(at["col"])
            return F.struct(row.alias("row"), col.alias("col"))

        def once(x: Column) -> Column:
            start = F.struct(F.floor(x / low).alias("row"), F.pmod(x, low).alias("col"))
            return F.aggregate(F.array(*[F.lit(r) for r in order]), start, turn, lambda at: at["row"] * low + at["col"])

        again = lambda x: F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, lambda y, _: F.when(y < n, y).otherwise(once(y))))
        return _bound(once(index), again)

    high, low = _grid(n)
    return _bound(F.struct(high.alias("high"), low.alias("low")), within)


def _permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, keyed: an index is a row and a column of a grid; ROUNDS rounds
    shift one of them by a hash of the other, which is a bijection each time."""
    return _rounds(index, n, key, list(range(ROUNDS)), 1)


def _permuted_back(index: Column, n: Column, key: Column) -> Column:
    """The inverse of _permuted: the rounds are taken back in reverse."""
    return _rounds(index, n, key, list(reversed(range(ROUNDS))), -1)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, target) of sizes(source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the total; a target stops at
    three times its source's size and the excess is reshared by weight until none is above: that is
    least(cap, level * weight) at the level where the sum is the total, found by one running sum.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", (F.pmod("source_no", F.lit(3)) + 1).cast("double")).withColumn("cap", 3.0 * F.col("source_size"))
    everything = W.Window.partitionBy()
    by_ratio = W.Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(W.Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    # the level if this source and all after it stay below their caps; the first for which that holds is the level
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("used")))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(everything)["level"])
    return s.select("source", "source_no", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_blocks(docs: DataFrame, seed: int = 0, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, Scratch]:
    """(documents, uses): every row of docs(doc_id, text, source, ...) with its place, and the pieces the mix takes.

    documents: doc_id, the columns named by carry, order (a hash of doc_id and text), source_no, size, source_size, target, offset: the row's first word in its
    source's stream. uses: source_no, offset, size (of the document), turn, shard, slot, first, last: in that turn through the
    source the output slot takes the words first..last-1 of the document. Each source's stream of words is
    packed into blocks of BLOCK words (the last one is shorter). The output is a row of shards of SHARD slots. First
    each shard's source counts are drawn: multinomial ones given each source's total, which a pseudorandom order of all slots
    yields. Slots then follow from the counts: a source's slots are numbered through the shards, and its k-th slot takes
    block pi_turn(k mod n) with turn = k div n and a fresh permutation pi each turn, so a turn
    takes every word once; the last one stops at the target. Targets never exceed three turns.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select("doc_id", *carry, "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("order"))
    rows = scratch.keep(rows, "rows")
    sources = scratch.keep(source_targets(rows), "sources")
    # offsets within a source: sums over buckets of a source first, then within each bucket
    most = rows.groupBy("source").agg(F.ceil(F.count("*") / PER_BUCKET).cast("long").alias("buckets"))
    plan = small(scratch.keep(sources.join(most, sources.source.eqNullSafe(most.source)).select(sources["*"], "buckets"), "plan"))
    placed = rows.join(plan, rows.source.eqNullSafe(plan.source)).select("doc_id", *carry, "size", "order", plan.source_no, "source_size", "target", F.pmod("order", F.col("buckets")).alias("bucket"))
    starts = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = W.Window.partitionBy("source_no").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = small(scratch.keep(starts.select(F.col("source_no").alias("s"), F.col("bucket").alias("k"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start")), "starts"))
    within = W.Window.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    documents = placed.join(starts, (F.col("source_no") == F.col("s")) & (F.col("bucket") == F.col("k"))).select("doc_id", *carry, "order", "source_no", "size", "source_size", "target", (F.col("start") + F.col("inside")).alias("offset"))
    documents = scratch.keep(documents, "documents")

    # slots: how many each source gets, and which
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    quota = sources.where("source_size > 0 and target > 0").select("source_no", "source_size", whole.cast("long").alias("whole"), rest.alias("rest"), blocks.alias("blocks"))
    # the last turn takes the first of the permuted blocks until rest words are had; the one short block adds at most one slot
    quota = quota.withColumn("slots", F.col("whole") * F.col("blocks") + F.when(F.col("rest") > 0, F.least("blocks", F.ceil(F.col("rest") / BLOCK) + 1)).otherwise(0))
    quota = quota.withColumn("from", F.coalesce(F.sum("slots").over(W.Window.orderBy("source_no").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("slots").over(W.Window.partitionBy()))
    quota = scratch.keep(quota, "quota")
    total = quota.agg(F.coalesce(F.max("all"), F.lit(0)).alias("n")).first().n
    step = 1 << 16  # a slot finds its source by its stretch of slots, so that the join is on equality
    stretches = quota.where("slots > 0").select("source_no", "from", "slots", F.explode(F.sequence(F.floor(F.col("from") / step), F.floor((F.col("from") + F.col("slots") - 1) / step))).alias("stretch"))
    drawn = docs.sparkSession.range(total).withColumnRenamed("id", "i").withColumn("stretch", F.floor(F.col("i") / step))
    drawn = drawn.join(small(scratch.keep(stretches, "stretches")), "stretch").where("i >= `from` and i < `from` + slots")
    place = _permuted(F.col("i"), F.lit(total).cast("long"), F.lit(seed).cast("long"))
    # the draw: how many slots of each shard go to each source, and how many the source has had in the shards before
    counts = drawn.select("source_no", F.floor(place / SHARD).alias("shard")).groupBy("source_no", "shard").agg(F.count("*").alias("drawn")).withColumn("run", F.floor(F.col("shard") / SHARDS_TOGETHER))
    counts = scratch.keep(counts, "counts")
    runs = counts.groupBy("source_no", "run").agg(F.sum("drawn").alias("in_run"))
    earlier = W.Window.partitionBy("source_no").orderBy("run").rowsBetween(W.Window.unboundedPreceding, -1)
    runs = small(scratch.keep(runs.select("source_no", "run", F.coalesce(F.sum("in_run").over(earlier), F.lit(0)).alias("had")), "runs"))
    inside = W.Window.partitionBy("source_no", "run").orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
    beside = W.Window.partitionBy("shard").orderBy("source_no").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_run", F.coalesce(F.sum("drawn").over(inside), F.lit(0))).withColumn("first_slot", F.coalesce(F.sum("drawn").over(beside), F.lit(0)))
    # a count is a small row that stands for many slots, so rows are dealt by what they stand for
    slot = counts.join(runs, ["source_no", "run"]).repartition(min(MOST_PARTS, total // SLOTS_EACH + 1), "source_no", "shard")
    slot = slot.withColumn("nth_here", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)))
    slot = slot.join(small(quota.select("source_no", "source_size", "whole", "rest", "blocks")), "source_no")
    k = F.col("had") + F.col("in_run") + F.col("nth_here")
    mixed_up = _permuted(F.col("first_slot") + F.col("nth_here"), F.least(F.lit(SHARD).cast("long"), F.lit(total) - F.col("shard") * SHARD), F.xxhash64("shard", F.lit(seed)))
    slot = slot.select("source_no", "source_size", "whole", "rest", "blocks", k.alias("k"), F.floor(k / F.col("blocks")).alias("turn"), "shard", mixed_up.alias("slot"))
    nth = F.col("k") - F.col("turn") * F.col("blocks")
    key = F.xxhash64("source_no", "turn", F.lit(seed))
    # where in each turn the one short block comes
    turns = quota.where("slots > 0").select("source_no", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("blocks")))).alias("turn"))
    turns = scratch.keep(turns.select("source_no", "turn", _permuted_back(F.col("blocks") - 1, F.col("blocks"), key).alias("short_at")), "turns")
    slot = slot.select("*", nth.alias("nth"), _permuted(nth, F.col("blocks"), key).alias("block")).join(small(turns), ["source_no", "turn"])
    size = F.when(F.col("block") == F.col("blocks") - 1, F.col("source_size") - BLOCK * (F.col("blocks") - 1)).otherwise(F.lit(BLOCK))
    missing = F.when(F.col("nth") > F.col("short_at"), BLOCK * F.col("blocks") - F.col("source_size")).otherwise(0)
    taken = F.when(F.col("turn") < F.col("whole"), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("rest") - (F.col("nth") * BLOCK - missing))))
    slot = slot.select("source_no", "block", "turn", "shard", "slot", taken.alias("words")).where("words > 0")

    pieces = documents.where("size > 0").select("source_no", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / BLOCK), F.floor((F.col("offset") + F.col("size") - 1) / BLOCK))).alias("block"))
    uses = pieces.join(slot, ["source_no", "block"])
    start = F.col("block") * BLOCK - F.col("offset")
    uses = uses.select("source_no", "offset", "size", "turn", "shard", "slot", F.greatest(F.lit(0), start).alias("first"), F.least(F.col("size"), start + F.col("words")).alias("last")).where("first < last")
    return documents, uses, scratch


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, places) for every row of docs(doc_id, text, source, ...).

    places: (turn, shard, slot, first, last) for each output slot that takes words of the document, in order.

    A null text has size 0 and is taken 0 times; a null source is a source of its own; repeated rows
    follow each other in their source's stream and are taken separately. An empty table gives none.
    """
    documents, uses, _ = mix_blocks(docs, seed)
    sums = uses.groupBy("source_no", "offset").agg(F.sum(F.col("last") - F.col("first")).alias("got"), F.sort_array(F.collect_list(F.struct("turn", "shard", "slot", "first", "last"))).alias("places"))
    place = sums.select(F.col("source_no").alias("s"), F.col("offset").alias("o"), "got", "places")
    joined = documents.join(place, (F.col("source_no") == F.col("s")) & (F.col("offset") == F.col("o")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), F.coalesce("places", F.array().cast("array<struct<turn:bigint,shard:bigint,slot:bigint,first:bigint,last:bigint>>")).alias("places"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix as rows of documents. A document appears once for each turn in which words of it
    are taken: whole, or with the taken words only, joined by spaces (n_chars follows). One that the mix does not draw goes.

    Null and empty texts have no words and go; a null source or doc_id is a value like any other; rows that differ in any column
    are drawn apart, rows that are equal in all columns each have their own turns; an empty table stays empty.
    """
    cells = [F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(*cells).alias("k0"), F.xxhash64(F.lit(1), *cells, F.lit(1)).alias("k1"))
    scratch = Scratch(spark, "mix-stage")
    plain = keyed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source"), "k0", "k1")
    with passing():  # of the mix only what each row gives is needed further on
        documents, uses, _ = mix_blocks(plain, carry=("k0", "k1"))
        turns = uses.groupBy("source_no", "offset", "size", "turn").agg(F.sum(F.col("last") - F.col("first")).alias("got"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
        turns = turns.select(F.col("source_no").alias("s"), F.col("offset").alias("o"), F.when(F.col("got") < F.col("size"), F.col("spans")).alias("spans"))
        places = documents.where("size > 0").select("k0", "k1", "source_no", "offset")
        takes = scratch.keep(places.join(turns, (F.col("source_no") == F.col("s")) & (F.col("offset") == F.col("o"))).select("k0", "k1", "spans"), "takes")
    # rows that are equal in every column collapse to one, which meets the turns of all of them
    rows = keyed.groupBy("k0", "k1").agg(F.first("row").alias("row")).join(takes, ["k0", "k1"])
    whole = F.col("spans").isNull()
    all_words = F.array(F.regexp_extract_all("row.text", F.lit(f"[^{_SPACE}]+"), F.lit(0)))  # bound to a name, so that they are found once
    cut = lambda found: F.flatten(F.transform(F.col("spans"), lambda x: F.slice(found, (x["first"] + 1).cast("int"), (x["last"] - x["first"]).cast("int"))))
    part = F.get(F.transform(all_words, lambda found: F.array_join(cut(found), " ")), F.lit(0))
    rows = rows.withColumn("left", F.when(whole, F.col("row.text")).otherwise(part))
    change = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[change.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole table documents; see mixture for nulls, empty texts, ties and repeated rows."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
