"""Op 4: document fingerprints by randomised edit embedding, bit-sampled banding and verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, bucket_links, bucket_ways, components, mix, released, shared_members

#: Sampled positions of a walk; bytes kept of each sampled character; classes of characters and period of the walk's random bits.
SAMPLES, CLASSES, PERIOD = 256, 64, 1 << 15
#: Bands of sampled positions and positions in each; likeness from which two fingerprints link, as a fraction.
BANDS, WIDTH = 12, 5
NEAR = (3, 4)
#: Rows of a sample, for each stretch, from which the borders of stretches are taken.
BORDER_ROWS = 50
_tables: list = []


def _walks() -> np.ndarray:
    """For each class of characters and step of the period, how many steps a walk rests there before it moves on.

    At each step the random bit of (step, class) says whether the walk moves to the next character; all
    texts share the bits. Repeats of the period let a run of zeros end.
    """
    if not _tables:
        rng = np.random.Generator(np.random.PCG64(20240229))
        bits = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.int8)
        wait = np.zeros((CLASSES, PERIOD), np.int16)
        nxt = np.full(CLASSES, 1, np.int16)
        for _ in range(2):
            for step in range(PERIOD - 1, -1, -1):
                nxt = np.where(bits[:, step] == 1, 1, np.minimum(nxt + 1, 1000)).astype(np.int16)
                wait[:, step] = nxt
        _tables.append(wait.reshape(-1).astype(np.int32))
        _tables.append(wait.tolist())
    return _tables[0]


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def sample_positions(length: int) -> np.ndarray:
    """The SAMPLES steps of least hash below length, in order. A longer text's sample, cut to a shorter length, is
    part of the shorter one's, so any two fingerprints share the positions that compare them."""
    if length <= SAMPLES:
        return np.arange(length)
    have = _samples.get(length.bit_length())
    if have is None:
        top = 1 << length.bit_length()
        h = _mix32(np.arange(top, dtype=np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x1234567))
        near = np.flatnonzero(h < np.uint32(min(0xFFFFFFFF, (1 << 32) * 16 * SAMPLES // top)))
        have = _samples[length.bit_length()] = (near[np.argsort(h[near], kind="stable")], h)
    near, h = have
    fit = near[near < length][:SAMPLES]
    if len(fit) < SAMPLES:
        fit = np.argsort(h[:length], kind="stable")[:SAMPLES]
    return np.sort(fit)


_samples: dict[int, tuple] = {}


def embed(texts: list[np.ndarray]) -> list[bytes]:
    """Fingerprints of texts (arrays of code points): the walk's length and, at the sampled steps, a byte for the character it rests at.

    All walks of a batch advance together, one character at a time; the few longest are finished alone.
    """
    wait = _walks()
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    hashed = [_mix32(texts[i].astype(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(1)) for i in order]
    flat = np.concatenate(hashed) if hashed else np.zeros(0, np.uint32)
    kinds = (flat & np.uint32(CLASSES - 1)).astype(np.int64) * PERIOD
    begin = np.r_[0, np.cumsum(sizes)]
    at = np.zeros(len(flat) + 1, np.int64)  # the step at which each character is left
    step = np.zeros(len(order), np.int64)
    most = int(sizes[0]) if len(sizes) else 0
    live = len(order)
    i = 0
    counts = np.searchsorted(-sizes, -np.arange(most + 1), "left") if most else np.zeros(1, np.int64)  # texts longer than i
    while i < most:
        live = int(counts[i])
        if live < 12:
            break
        where = begin[:live] + i
        step[:live] += wait[kinds[where] + (step[:live] & (PERIOD - 1))]
        at[where] = step[:live]
        i += 1
    rows = _tables[1]
    for k in range(live if i < most else 0):
        s, mask = int(step[k]), PERIOD - 1
        rest = (kinds[begin[k] + i : begin[k + 1]] // PERIOD).tolist()
        left = []
        for c in rest:
            s += rows[c][s & mask]
            left.append(s)
        at[begin[k] + i : begin[k + 1]] = left
        step[k] = s
    out: list[bytes] = [b""] * len(order)
    for k, original in enumerate(order):
        length = int(step[k])
        steps = sample_positions(length)
        own = at[begin[k] : begin[k + 1]]
        seen = hashed[k][np.searchsorted(own, steps, "right")] if length else np.zeros(0, np.uint32)
        out[original] = length.to_bytes(4, "big") + (seen >> np.uint32(24)).astype(np.uint8).tobytes()
    return out


def likeness(a: bytes, b: bytes) -> float:
    """The estimated share of steps at which two walks rest at equal characters, of the longer walk's steps; equal fingerprints give 1."""
    if a == b:
        return 1.0
    la, lb = int.from_bytes(a[:4], "big"), int.from_bytes(b[:4], "big")
    if la < lb:
        a, b, la, lb = b, a, lb, la
    if not lb:
        return 0.0
    pa_, pb = sample_positions(la), sample_positions(lb)
    both = pa_[pa_ < lb]
    va = np.frombuffer(a, np.uint8, offset=4)[: len(both)]
    vb = np.frombuffer(b, np.uint8, offset=4)[np.searchsorted(pb, both)]
    return float((va == vb).sum() / len(pa_))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text: lower-case hex; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                prints = embed([_points(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.hex() for p in prints], pa.string())], ["k", "fingerprint"])

    return docs.select(key, text).mapInArrow(released(run), f"k {docs.schema[key].dataType.simpleString()}, fingerprint string").withColumnRenamed("k", key)


def marks(fingerprint: bytes) -> np.ndarray:
    """The sampled steps with the bytes kept at them, as a sorted set of numbers: two sets share what two walks have in common."""
    steps = sample_positions(int.from_bytes(fingerprint[:4], "big"))
    return steps.astype(np.uint64) << np.uint64(8) | np.frombuffer(fingerprint, np.uint8, offset=4)


def band_keys(fingerprint: bytes) -> np.ndarray:
    """A key for each band: WIDTH of the steps that fall to the band by hash, those of the least hash of all up to the walk's end.

    So bands sample the whole walk, and walks of nearly the same length read nearly the same steps.
    """
    own = marks(fingerprint)
    h = _mix32((own >> np.uint64(8)).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7654321))
    order = np.lexsort((h, h % np.uint32(BANDS)))
    band = (h % np.uint32(BANDS))[order]
    rank = np.arange(len(order)) - np.searchsorted(band, band)
    chosen = order[rank < WIDTH]
    band = (h % np.uint32(BANDS))[chosen].astype(np.int64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    np.add.at(keys, band, mix(own[chosen] * np.uint64(0xD6E8FEB86659FD93) + band.astype(np.uint64)))
    return mix(keys)


def _digest(fingerprint: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(fingerprint, digest_size=8).digest(), "big", signed=True)


def _order(text: Column) -> list[Column]:
    """Columns by which rows are in descending order of doc_id, nulls last; equal ones by a hash of the text."""
    return [F.col("doc_id").isNull().cast("int").alias("o1"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("o2"), F.xxhash64(text).alias("o3")]


def near_classes(docs: DataFrame) -> DataFrame:
    """(o1, o2, o3, near_id, print) of every place in the order of docs(doc_id, text), with its fingerprint: near_id is the smallest doc_id reachable where the fingerprint links with one of another row, else null.

    Fingerprints link when they agree in NEAR of the steps of the longer walk, which estimates that texts are few edits apart; equal ones are one
    vertex. They meet in buckets of BANDS bit-sampled bands, and all pairs of a bucket are verified on whole fingerprints. At a likeness
    of 0.75 the bands find 0.96 of pairs, at 0.8 0.99.
    """
    scratch = Scratch(docs.sparkSession, "near")

    def sign(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                prints = embed([_points(t) for t in part.column(3).to_pylist()])
                own = [part.column(i) for i in range(3)] + [part.column(4)]
                keys = [band_keys(p).tobytes() for p in prints]
                yield pa.RecordBatch.from_arrays([*own, pa.array([_digest(p) for p in prints], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.binary())], ["o1", "o2", "o3", "doc_id", "id", "print", "keys"])

    rows = docs.select(*_order(F.col("text")), "text", "doc_id")
    signed = scratch.keep(rows.mapInArrow(released(sign), "o1 int, o2 long, o3 long, doc_id long, id long, print binary, keys binary"), "signed")
    members = scratch.keep(shared_members(signed.select("id", F.lit(2 * SAMPLES).alias("size"), "keys"), BANDS).distinct(), "members")
    ways = scratch.keep(bucket_ways(scratch, members), "ways")
    # of rows with equal fingerprints one is enough; should two share a digest, the smaller stands for it
    asked = signed.select("id", "print").join(ways.select("id").distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("print").alias("data"))
    payload = scratch.keep(asked.select("id", F.lit(0).alias("tie"), "data"), "payload")
    num, den = NEAR
    links = bucket_links(scratch, ways, payload, lambda data: [marks(x) for x in data.to_pylist()], lambda x, y: -(-num * np.maximum(x, y) // den))
    parts = components(scratch, links, "near")
    grouped = signed.groupBy("id").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).join(parts.hint("merge"), "id", "left").select("id", "low", "n", F.coalesce("component", "id").alias("part"))
    grouped = scratch.keep(grouped, "grouped")
    classes = grouped.groupBy("part").agg(F.min("low").alias("near_id"), F.sum("n").alias("n")).where("n > 1 and near_id is not null")
    named = scratch.keep(grouped.join(classes.select("part", "near_id").hint("merge"), "part").select("id", "near_id"), "named")
    scratch.drop("members", "ways", "payload")
    linked = signed.select("o1", "o2", "o3", "id").join(named.hint("merge"), "id").groupBy("o1", "o2", "o3").agg(F.min("near_id").alias("near_id"))
    prints = signed.groupBy("o1", "o2", "o3").agg(F.min("print").alias("print"))
    out = scratch.keep(prints.join(linked.hint("merge"), ["o1", "o2", "o3"], "left").select("o1", "o2", "o3", "near_id", "print"), "classes")
    scratch.drop("signed")
    return out


def with_edits(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_id) for every row of docs(doc_id, text, ...).

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's, in descending order of doc_id (after the last: the first). Null texts are empty. Rows of
    equal doc_id follow each other by a hash of the text; null doc_ids come last. near_id is the smallest doc_id of the
    fingerprint's class (see near_classes, whose fingerprints are taken over, so that only the edited text is embedded here), the row's own if it links with nothing; without classes it is null. Repeated rows each give
    a row; other columns are ignored; an empty table gives no rows.

    Rows are dealt to stretches of this order, whose borders come from a small sample (they decide where rows lie, not what comes out); the first row of
    each stretch is also sent to the one before, so each text is shuffled once and no task orders all rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["o1", "o2", "o3"]
    place = docs.select(*_order(F.col("text")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = docs.count()
    share = min(1.0, BORDER_ROWS * parts / max(1, count))
    drawn = sorted(tuple(r) for r in place.where(F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)).distinct().collect())
    cuts = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []
    own = F.struct(*[F.col(k) for k in keys])
    if cuts:  # the number of cuts up to the row, by halving
        listed = F.array(*[F.struct(F.lit(a).alias("o1"), F.lit(b).cast("long").alias("o2"), F.lit(c).cast("long").alias("o3")) for a, b, c in cuts])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        stretch = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(listed, low + step - 1) <= own), low + step).otherwise(low))
    else:
        stretch = F.lit(0)
    heads = place.withColumn("stretch", stretch).groupBy("stretch").agg(F.min(own).alias("head")).orderBy("stretch").collect()
    none = F.lit(None).cast("long")
    rows = docs.select(*_order(F.col("text")), F.lit(1).alias("kind"), "doc_id", "text", none.alias("near_id"), F.lit(None).cast("binary").alias("print")).withColumn("stretch", stretch).withColumn("copy", F.lit(0))
    first = spark.createDataFrame([(*r.head, heads[i - 1].stretch) for i, r in enumerate(heads)], "o1 int, o2 long, o3 long, back int")
    copies = rows.join(F.broadcast(first), keys).select(*rows.columns[:-2], F.col("back").alias("stretch"), F.lit(1).alias("copy"))
    rows = rows.unionByName(copies)
    if classes is not None:
        named = classes.select(*keys, F.lit(0).alias("kind"), none.alias("doc_id"), F.lit("").alias("text"), "near_id", "print").withColumn("stretch", stretch).withColumn("copy", F.lit(0))
        rows = rows.unionByName(named)
    rows = rows.repartitionById(len(cuts) + 1, "stretch").sortWithinPartitions("stretch", "copy", *keys, "kind", "text")

    def finish(batch_rows):
        """batch_rows: (doc_id, text, next text, near_id, fingerprint, next fingerprint); fingerprints that are not known yet are made."""
        texts = []
        for _, text, follow, *_ in batch_rows:
            own, nxt = _points(text), _points(follow)
            third = len(own) // 3
            texts.append((own, np.r_[own[: len(own) - third], nxt[:third]].astype(np.uint32), nxt))
        index: dict[bytes, int] = {}
        slots = [[index.setdefault(t.tobytes(), len(index)) if known is None else known for t, known in zip(three, (own, None, nxt), strict=True)] for three, (*_, own, nxt) in zip(texts, batch_rows, strict=True)]
        prints = embed([np.frombuffer(t, np.uint32) for t in index])
        out = []
        for (ident, _, _, near, *_), three, at in zip(batch_rows, texts, slots, strict=True):
            own, edited, nxt = (prints[x] if isinstance(x, int) else x for x in at)
            raw = three[1].astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
            out.append((ident, len(three[0]), hashlib.sha256(raw).hexdigest(), own.hex(), edited.hex(), likeness(own, edited), likeness(own, nxt), near))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    judged = classes is not None

    def run(batches):
        held: tuple | None = None  # (doc_id, text, near_id, fingerprint): waits for the next text
        named: tuple = (None, None, None)  # the place in the order that the last class is of, the class and the fingerprint
        done: list[tuple] = []
        size, where, border = 0, None, False
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for o1, o2, o3, kind, ident, text, near, print_, stretch, copy in zip(*(part.column(at[c]).to_pylist() for c in ("o1", "o2", "o3", "kind", "doc_id", "text", "near_id", "print", "stretch", "copy")), strict=True):
                    if kind == 0:
                        named = ((o1, o2, o3), near, print_)
                        continue
                    _, near, print_ = named if named[0] == (o1, o2, o3) else (None, None, None)
                    if held is not None and where == stretch and not border:
                        done.append((held[0], held[1], text, held[2], held[3], print_))
                        size += 3 * len(held[1]) + len(text)
                    border, where = copy == 1, stretch
                    held = (ident, text, None if not judged else near if near is not None else ident, print_)
                    if size > 4_000_000:
                        yield finish(done)
                        done, size = [], 0
        yield finish(done)

    return rows.select(*keys, "kind", "doc_id", "text", "near_id", "print", "stretch", "copy").mapInArrow(
        released(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long"
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, edits and near classes of all documents; see with_edits and near_classes for nulls, ties and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_edits(docs, near_classes(plain))
