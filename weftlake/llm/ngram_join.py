"""Op 3: exact Jaccard join on word n-grams by rare-first prefix filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, chunks, components, distinct_sorted, mix, numbered, passing, released, shingles, small, verify

#: Counters in each of the two rows of the frequency sketch: its size does not grow with the corpus.
SKETCH = 1 << 17
PARTS = 16
#: Tokens whose frequency among prefixes is counted exactly and broadcast (9 MB).
FREQUENT = 1_000_000
#: Rounds after the first star: all but the last meet a member of a token's main component and one outside, the last holds all remaining pairs.
ROUNDS = 2


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64), ((h >> np.uint64(17)) & np.uint64(SKETCH - 1)).astype(np.int64)


def frequency_classes(texts: DataFrame, text: str) -> np.ndarray:
    """A class 0..62 for each counter of a count-min sketch over all shingles of all texts; a higher class is more frequent."""

    def count(batches):
        total = np.zeros((2, SKETCH), np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                for row, slot in enumerate(_slots(shingles(data, offsets)[0])):
                    total[row] += np.bincount(slot, minlength=SKETCH)
        parts = total.reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    rows = texts.select(text).mapInArrow(released(count), schema).repartition(PARTS, "part").mapInArrow(released(add), schema).collect()
    total = np.zeros((PARTS, 2 * SKETCH // PARTS), np.int64)
    for part, counts in rows:
        total[part] += np.frombuffer(counts, np.int64)
    total = total.reshape(2, SKETCH)
    usual = float(np.median(total)) if total.any() else 0.0
    excess = np.where(total - usual > 3 * np.sqrt(usual + 1), total - usual, 0)
    return _class_of(excess)


def _class_of(counts: np.ndarray) -> np.ndarray:
    return np.clip(2 * np.log2(1 + counts), 0, 126).astype(np.uint8)


def frequent_tokens(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hash bits and classes of the tokens that most sets have in their prefixes: exact where the sketch is too coarse.

    At most FREQUENT of them, the most frequent; any order of tokens gives the same pairs, a better one fewer candidates.
    """
    bits = F.explode("prefix").alias("token")
    counted = sets.select(bits).select(F.col("token").bitwiseAND(F.lit((1 << 57) - 1)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    order = np.argsort(top["token"].to_numpy(np.uint64))
    return top["token"].to_numpy(np.uint64)[order], _class_of(top["n"].to_numpy(np.float64)[order])


def ordered(h: np.ndarray, classes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Shingle hashes as tokens whose order is the global one: rarer classes first, then by hash."""
    a, b = _slots(h)
    rank, bits = np.minimum(classes[0][a], classes[1][b]), h >> np.uint64(7)
    if frequent is not None and len(frequent[0]):
        at = np.searchsorted(frequent[0], bits)
        at[at == len(frequent[0])] = 0
        rank = np.maximum(rank, np.where(frequent[0][at] == bits, frequent[1][at], 0))
    return (np.minimum(rank, 62).astype(np.uint64) << np.uint64(57)) | bits


def document_sets(docs: DataFrame, classes, num: int, den: int, frequent=None) -> DataFrame:
    """(doc_id, n, sig0, sig1, prefix): size, two digests of the set, and its rarest tokens in order."""

    def build(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                h, upto = shingles(data, offsets)
                token = ordered(h, classes.value, frequent.value if frequent is not None else None)
                n, sig, prefix = [], [], []
                for i in range(len(upto) - 1):
                    own = distinct_sorted(token[upto[i] : upto[i + 1]])
                    n.append(len(own))
                    sig.append((int(own.sum(dtype=np.uint64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))))
                    prefix.append(own[: len(own) - -(-num * len(own) // den) + 1] if len(own) else own)
                flat = np.concatenate(prefix).view(np.int64)
                ends = np.r_[0, np.cumsum([len(p) for p in prefix])].astype(np.int32)
                sigs = np.array(sig, np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "n", "sig0", "sig1", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(build), "doc_id long, n long, sig0 long, sig1 long, prefix array<long>")


def ngram_groups(docs: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text, ...).

    Documents link when den * |intersection| >= num * |union| of their distinct 5-word shingles
    (words are lower-cased in A-Z and split at ASCII white space; a text of one to four words is one
    shingle). component_id is the smallest doc_id reachable over links. A null or empty text has no
    shingles and is alone; a null doc_id gets a null component; rows that share a doc_id are one
    vertex. Other columns are ignored; an empty table gives an empty result.

    Steps: tokens are ordered by a frequency sketch of all shingles, and by exact counts among the prefixes that
    it gives; equal sets collapse to their smallest doc_id; the rarest tokens of each set are joined;
    one round links every member of a token's group to the group's best connected set, which joins
    groups of copies at linear cost; the next links strays to varying members of the group; the
    last holds all remaining pairs from different components against each other. Each pair is verified once, on whole texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    docs = docs.select("doc_id", "text")
    classes = spark.sparkContext.broadcast(frequency_classes(docs, "text"))
    rough = scratch.keep(document_sets(docs, classes, num, den), "rough")
    frequent = spark.sparkContext.broadcast(frequent_tokens(rough))
    scratch.drop("rough")
    whole = scratch.keep(document_sets(docs, classes, num, den, frequent), "whole")
    full = whole.where("n > 0 and doc_id is not null")
    reps = scratch.keep(full.groupBy("sig0", "sig1").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "reps")
    sets = scratch.keep(whole.drop("prefix"), "sets")
    scratch.drop("whole")
    tokens = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    # members of a token are counted before the shuffle; in the join AQE can split a token that very many share
    members = reps.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    shared = scratch.keep(tokens.join(members.hint("merge"), "token"), "shared")
    reps = scratch.keep(reps.select("sig0", "sig1", "id"), "ids")
    scratch.drop("reps")
    rank = shared.groupBy("id").agg(F.sum("members").alias("degree"))
    ranked = scratch.keep(shared.join(rank, "id"), "ranked")
    centres = scratch.keep(ranked.groupBy("token").agg(F.max(F.struct("degree", "id", "n", "pos")).alias("c")).select("token", F.col("c.id").alias("b"), F.col("c.n").alias("nb"), F.col("c.pos").alias("pb")), "centres")
    likely = (F.col("n") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("n") * num)
    # of a linked pair, the first common token leaves room for the overlap that the threshold needs in both suffixes
    fits = (num + den) * F.least(F.col("n") - F.col("pos"), F.col("nb") - F.col("pb")) >= num * (F.col("n") + F.col("nb"))
    star = ranked.join(centres, "token").where((F.col("id") != F.col("b")) & likely & fits).select(F.col("id").alias("a"), "b").distinct()
    star = scratch.keep(star, "star")
    scratch.drop("ranked", "centres")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")

    def tokenise(column):
        out = []
        for _, data, offsets in chunks(column):
            h, upto = shingles(data, offsets)
            out += [distinct_sorted(h[upto[i] : upto[i + 1]]) for i in range(len(upto) - 1)]
        return out

    links, done = scratch.keep(verify(scratch, star, texts, tokenise, num, den), "links0"), star
    for turn in range(1, ROUNDS + 1):
        parts = components(scratch, links, f"near{turn}")
        rest = scratch.keep(shared.join(parts, "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("part")), f"rest{turn}")
        by_part = rest.groupBy("token", "part").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "part")).alias("m"), F.count("*").alias("parts"))
        mixed = scratch.keep(by_part.where("parts > 1").select("token", F.col("m.part").alias("main")), f"main{turn}")
        open_ = scratch.keep(rest.join(mixed, "token"), f"open{turn}")
        if turn < ROUNDS:  # members outside the main component meet one member of it and one outside for each token, others for each token
            pick = open_.groupBy("token", (F.col("part") == F.col("main")).alias("inside")).agg(F.min(F.struct(F.xxhash64("token", "id", F.lit(turn)).alias("h"), "id", "n", "pos", "part")).alias("c"))
            pick = scratch.keep(pick.select("token", F.col("c.id").alias("b"), F.col("c.n").alias("nb"), F.col("c.pos").alias("pb"), F.col("c.part").alias("part_b")), f"pick{turn}")
            pairs = open_.where("part <> main").join(pick, "token").where((F.col("part") != F.col("part_b")) & likely & fits)
        else:  # all pairs of different components that are left
            other = open_.where("part <> main").select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("part").alias("part_b"))
            pairs = open_.join(other, "token").where((F.col("part") != F.col("part_b")) & likely & fits)
        pairs = pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
        both = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = scratch.keep(pairs.join(both, ["a", "b"], "left_anti"), f"pairs{turn}")
        more = scratch.keep(verify(scratch, pairs, texts, tokenise, num, den), f"links{turn}")
        links, done = links.unionByName(more), done.unionByName(pairs)
        scratch.drop(f"rest{turn}", f"open{turn}")
    parts = components(scratch, links, "all")
    groups = reps.select("sig0", "sig1", "id").join(parts, "id", "left").select("sig0", "sig1", F.coalesce("component", "id").alias("component"))
    groups = scratch.keep(groups, "groups")
    return (
        sets.join(groups, ["sig0", "sig1"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"))
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and components of all documents; see ngram_groups for nulls, empty and long texts, ties and repeated rows."""
    return ngram_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the smallest doc_id stays.

    Null and empty texts and rows with a null doc_id stay; unlike texts that share a doc_id are documents of their own, ordered by a hash of the text, and rows equal in doc_id and text
    stay or go together; an empty table stays empty; other columns pass through.
    """
    scratch = Scratch(spark, "ngram-stage")
    with passing():  # of the groups only what goes is needed further on
        if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
            gone = ngram_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.lit(0).cast("long").alias("version")).distinct()
            version = F.lit(0).cast("long")
        else:
            version = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
            keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), version.alias("version"), "text")
            keys = numbered(scratch, keyed.select(F.lit("").alias("all"), "id", "version").distinct(), "all", ["id", "version"], "keys")
            keys = scratch.keep(keys.select("id", "version", "pos"), "places")
            groups = ngram_groups(keyed.join(keys.hint("merge"), ["id", "version"]).select(F.col("pos").alias("doc_id"), "text"))
            gone = keys.join(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("pos")).distinct(), "pos").select(F.col("id").alias("gone_id"), "version")
        gone = scratch.keep(gone, "gone")
    rows = docs.select(F.struct("*").alias("row"), version.alias("own"))  # apart from the names that are used here
    return rows.join(small(gone), (F.col("row.doc_id") == F.col("gone_id")) & (F.col("own") == F.col("version")), "left_anti").select("row.*")


SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
c as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l as (select a, b from c union all select b, a from c),
r as (with recursive r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a) select a, min(b) as m from r group by a)
select doc_id, len(s)::bigint as n_shingles, m as component_id from s join r on r.a = s.doc_id
"""
