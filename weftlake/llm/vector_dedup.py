"""Op 6: embedding near-dedup by iterative quantisation, multi-index Hamming tables and reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, components, released

#: Vectors of each dimension from which rotations are learned (the only sampled step), and rounds of learning.
SAMPLE, LEARNING = 20_000, 30
#: Tables of a code; bits of a table's key beyond those that tell the largest group's vectors apart; least and most bits of a key.
TABLES, SPARE, NARROW, WIDE = 16, 2, 8, 20
#: Vectors of a bucket that are held against each other in one place.
BLOCK = 1024
#: Dimensions, the most numerous ones, for which rotations are learned; for others they are drawn.
LEARNED = 64


def learn_rotations(sample: np.ndarray, bits: int) -> np.ndarray:
    """Projection (d x bits) whose signs are codes: principal axes, turned so that unit vectors lie near the corners of a cube. One rotation gives d bits;
    more are learned from other starts and other halves of the sample.

    All planes go through the origin, where the cosine has its angle: whatever the data's mean, two vectors at a small angle fall on different sides of few
    of them. Codes about the mean would be balanced on data that lie off the origin too, but there the angle about the mean says nothing about the cosine.
    """
    d = sample.shape[1]
    _, _, axes = np.linalg.svd(sample, full_matrices=False) if len(sample) >= d else (None, None, np.eye(d))
    rng = np.random.Generator(np.random.PCG64(7))
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        v = sample @ axes.T
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        half = v[rng.random(len(v)) < 0.5] if len(v) > 20 * d else v
        for _ in range(LEARNING):
            u, _, w = np.linalg.svd(np.where(half @ turn >= 0, 1.0, -1.0).T @ half)
            turn = (u @ w).T
        parts.append(axes.T @ turn)
    return np.hstack(parts)[:, :bits]


def drawn_rotations(d: int, bits: int) -> np.ndarray:
    """The same without data: rotations drawn for the dimension."""
    rng = np.random.Generator(np.random.PCG64([7, d]))
    return np.hstack([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-bits // d))])[:, :bits]


def key_width(sample: np.ndarray, project: np.ndarray, most: int) -> int:
    """Bits of a key: so many that of `most` vectors like the sample's few share one with an unrelated vector, by how often two of the sample agree in a bit."""
    rng = np.random.Generator(np.random.PCG64(11))
    x, y = (rng.permutation(sample)[:2000] @ project >= 0 for _ in range(2))
    agree = float((x == y).mean()) if len(x) else 0.5
    return min(WIDE, max(NARROW, math.ceil(math.log2(max(most, 1)) / -math.log2(min(max(agree, 0.5), 0.999))) + SPARE))


def radius(sample: np.ndarray, project: np.ndarray, least: float) -> float:
    """Bits in which the codes of two vectors at the least cosine may differ: far beyond what chance gives random planes, and beyond all that was measured on
    sampled vectors turned by that angle, in random directions and towards other vectors of the sample."""
    bits, angle = project.shape[1], math.acos(max(-1.0, min(1.0, least)))
    chance = angle / math.pi
    out = bits * chance + 7 * math.sqrt(bits * chance)
    if len(sample) > 1 and sample.shape[1] > 1:
        rng = np.random.Generator(np.random.PCG64(13))
        for towards in (rng.standard_normal(sample.shape), rng.permutation(sample)):
            aside = towards - (towards * sample).sum(1, keepdims=True) * sample
            size = np.linalg.norm(aside, axis=1)
            fine = size > 1e-9
            turned = math.cos(angle) * sample[fine] + math.sin(angle) * aside[fine] / size[fine, None]
            if fine.any():
                out = max(out, 1.25 * float(((turned @ project >= 0) != (sample[fine] @ project >= 0)).sum(1).max()))
    return out


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _blocks(batches, names: list[str]):
    """Whole blocks (key, block, other) of rows that are sorted by them, as lists by column."""
    held: dict[str, list] = {n: [] for n in names}
    key = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        for row in zip(*columns, strict=True):
            if row[:3] != key:
                if key is not None:
                    yield held
                key, held = row[:3], {n: [] for n in names}
            for n, x in zip(names, row, strict=True):
                held[n].append(x)
    if key is not None:
        yield held


def _first_met(block: dict[str, list]) -> np.ndarray:
    """Pairs of a block that this table is the first to bring together: of equal labels, one of each block if there are two."""
    keys = np.frombuffer(b"".join(block["code"]), np.int32).reshape(-1, TABLES)
    table, label, half, ids = block["t"][0], np.array(block["label"]), np.array(block["half"]), np.array(block["id"])
    met = (label[:, None] == label[None, :]) & (keys[:, table][:, None] == keys[:, table][None, :]) & (ids[:, None] != ids[None, :])
    if block["block"][0] != block["other"][0]:
        met &= half[:, None] != half[None, :]
    for t in range(table):
        met &= keys[:, t][:, None] != keys[:, t][None, :]
    return met


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label, ...).

    Rows link when their labels are equal and not null, their embeddings have the same number of components and a cosine of at least
    `least` in double precision. Null or zero vectors and such with null, NaN or infinite
    components link with nothing, nor do rows with a null vec_id (component null, not kept). n_links counts rows, equal vectors
    included; rows that share a vec_id are one vertex. No pair below the threshold is linked. Other columns are ignored; an empty table gives no rows.

    Equal vectors collapse to one first. A code is cut into TABLES keys, whose width follows the largest group of vectors of
    one label, so that unrelated vectors share few buckets at any size; on data that lie close together it ends at WIDE. Two vectors whose codes differ in fewer bits than there are tables always
    share one; at a cosine of 0.98 and keys of 20 bits, 0.993 of all pairs do, of 16 bits 0.999. A pair counts in the first table that brings it together. Codes too far
    apart go before vectors are sent; then all pairs of a bucket are reranked in blocks and leave counts and spanning edges, no rows of pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("v"))
    rows = rows.withColumn("h0", F.when(usable, F.xxhash64("label", "v"))).withColumn("h1", F.when(usable, F.xxhash64(F.lit(1), "label", "v")))
    good = rows.where("h0 is not null")
    reps = good.groupBy("h0", "h1").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.xxhash64(F.first("label")).alias("label"), F.first("v").alias("v"))
    reps = scratch.keep(reps.withColumn("d", F.size("v")).withColumn("id", F.col("h0")), "reps")
    groups = reps.groupBy("d", "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    sizes = [(r.d, r.n, r.most) for r in groups.orderBy(F.desc("n"), "d").limit(LEARNED).collect()]
    models = {}
    for d, n, most in sizes:
        drawn = reps.where(F.col("d") == d).where(F.pmod(F.xxhash64("h1"), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / n)).select("v").toPandas()
        x = np.array(drawn["v"].tolist(), float).reshape(len(drawn), d)
        x = x / np.abs(x).max(1, keepdims=True) if len(x) else np.eye(d)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        project = learn_rotations(x, WIDE * TABLES)
        width = key_width(x, project, most)
        models[d] = (width, radius(x, project[:, : width * TABLES], least), project[:, : width * TABLES])
    shared = spark.sparkContext.broadcast(models)

    def model(d: int) -> tuple[int, float, np.ndarray]:
        if d not in shared.value:
            project = drawn_rotations(d, NARROW * 2 * TABLES)
            shared.value[d] = (NARROW * 2, radius(np.zeros((0, d)), project, least), project)
        return shared.value[d]

    def encode(batches):
        for batch in batches:
            codes = np.zeros((batch.num_rows, TABLES), np.int32)
            lists, dims = batch.column(3), batch.column(2).to_numpy()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
            for d in set(dims.tolist()):
                width, _, project = model(d)
                at = np.flatnonzero(dims == d)
                x = flat[(ends[:-1][at][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                x = x / np.abs(x).max(1, keepdims=True)  # very large components do not overflow
                bits = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ project) >= 0
                codes[at] = (bits.reshape(len(at), TABLES, width).astype(np.int32) << np.arange(width, dtype=np.int32)).sum(2, dtype=np.int32)
            made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["id", "label", "d", "code", "keys"])

    coded = scratch.keep(reps.select("id", "label", "d", "v").mapInArrow(released(encode), "id long, label long, d int, code binary, keys array<int>"), "codes")
    index = coded.select("id", "label", "d", "code", F.posexplode("keys").alias("t", "part")).withColumn("key", F.xxhash64("label", "d", "t", "part"))
    buckets = index.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min("id").alias("low"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("digest")).where("n > 1")
    # the same vectors often meet in several tables: the first of them is enough
    buckets = buckets.groupBy("n", "low", "digest").agg(F.min(F.struct("t", "key")).alias("first")).select(F.col("first.key").alias("key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    ways = index.join(scratch.keep(buckets, "buckets").hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    ways = ways.select("key", "t", "id", "label", "d", "code", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    ways = ways.select("key", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"), "t", "id", "label", "d", "code", F.col("own").alias("half"))

    def reach(batches):
        """Members of a block that have a partner within the radius."""
        out = []
        for block in _blocks(batches, ["key", "block", "other", "t", "id", "label", "code", "half", "d"]):
            met = _first_met(block)
            if met.any():
                width, most, _ = model(block["d"][0])
                keys = np.frombuffer(b"".join(block["code"]), np.int32).reshape(-1, TABLES)
                bits = (keys[:, :, None] >> np.arange(width) & 1).reshape(len(keys), -1).astype(np.float32)
                ones = bits.sum(1)
                apart = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
                near = (met & (apart <= most)).any(1)
                out += [(block["key"][0], block["block"][0], block["other"][0], block["id"][i]) for i in np.flatnonzero(near)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["key", "block", "other", "id"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["key", "block", "other", "id"])

    ways = scratch.keep(ways, "ways")
    dealt = ways.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
    hopeful = scratch.keep(dealt.select("key", "block", "other", "t", "id", "label", "code", "half", "d").mapInArrow(released(reach), "key long, block int, other int, id long"), "hopeful")

    def rerank(batches):
        """For each member of a block the rows it links with and an edge of a spanning forest."""
        for block in _blocks(batches, ["key", "block", "other", "t", "id", "label", "code", "half", "copies", "v"]):
            sizes = {len(v) for v in block["v"]}
            if len(sizes) > 1:
                continue  # equal digests of different dimensions
            x = np.array(block["v"])
            x = x / np.abs(x).max(1, keepdims=True)
            squares = (x * x).sum(1)
            cosine = x @ x.T / np.sqrt(squares[:, None] * squares[None, :])
            for i, j in np.argwhere(np.abs(cosine - least) < 1e-9):  # sums in one order decide close calls
                cosine[i, j] = (x[i] * x[j]).sum() / np.sqrt(squares[i] * squares[j])
            linked = _first_met(block) & (cosine >= least)
            n = len(x)
            label = np.arange(n)
            while True:
                low = np.minimum(label, np.where(linked, label[None, :], n).min(1))
                low = low[low]
                if (low == label).all():
                    break
                label = low
            others = linked @ np.array(block["copies"], np.int64)
            some = np.flatnonzero(others)
            ids = np.array(block["id"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(others[some])], ["a", "b", "others"])

    sent = ways.join(hopeful.hint("merge"), ["key", "block", "other", "id"]).join(reps.select("id", "copies", "v").hint("merge"), "id").repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
    links = scratch.keep(sent.select("key", "block", "other", "t", "id", "label", "code", "half", "copies", "v").mapInArrow(released(rerank), "a long, b long, others long"), "links")
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("others").alias("others"))
    # vectors of rows that share a vec_id are one vertex
    several = good.groupBy("vec_id").agg(F.min("h0").alias("b"), F.max("h0").alias("most")).where("b < most").select("vec_id", "b")
    same = good.select("vec_id", F.col("h0").alias("a")).join(several, "vec_id").select("a", "b")
    cc = components(scratch, links.select("a", "b").unionByName(same), "vectors")
    decided = scratch.keep(reps.select("h0", "h1", "id", "low", "copies").join(counts, "id", "left").join(cc, "id", "left"), "joined")
    least_id = decided.where("component is not null").groupBy("component").agg(F.min("low").alias("least_id"))
    decided = decided.join(least_id, "component", "left")
    decided = scratch.keep(decided.select("h0", "h1", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least_id", "low").alias("component")), "decided")
    out = rows.select("vec_id", "h0", "h1").join(decided, ["h0", "h1"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of the table embeddings; see near_vectors for nulls, ties, repeated rows and odd vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as s from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
c as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id where a.s > 0 and b.s > 0 and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r as (with recursive r(a, b) as (select vec_id, vec_id from embeddings union select r.a, c.b from r join c on r.b = c.a) select a, min(b) as m from r group by a)
select vec_id, coalesce(k, 0)::bigint as n_links, m as component_id, vec_id = m as kept from embeddings join r on r.a = vec_id left join (select a, count(*) as k from c group by a) q on q.a = vec_id
"""
