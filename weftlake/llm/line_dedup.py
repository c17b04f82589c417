"""Op 2: fuzzy line dedup by MinHash, banding, exact Jaccard verification and distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlake.llm.common import Scratch, bucket_links, bucket_ways, chunks, components, distinct_sorted, mix, passing, released, shared_members

#: Characters in a shingle; bands and rows of the signature.
SHINGLE, BANDS, ROWS = 5, 10, 5
#: Empty lines are left out; all others are compared, one shorter than a shingle as one shingle.
MIN_CHARS = 1
#: Bytes of text that are hashed at once: few, so that the arrays stay in the cache.
STEP = 1 << 16
_NONE = np.uint32(0xFFFFFFFF)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PROBES = np.random.Generator(np.random.PCG64(7)).integers(0, BANDS * ROWS, (256, BANDS * ROWS))
#: Of each bin, the first probe that comes to each other one; the loop takes this many, then all that are left are settled at once, some thousands together.
_FIRST = np.full((BANDS * ROWS, BANDS * ROWS), len(_PROBES), np.uint16)
for _k in range(len(_PROBES) - 1, -1, -1):
    _FIRST[np.arange(BANDS * ROWS), _PROBES[_k]] = _k
_LOOP, _TOGETHER = 3, 1 << 13
_STEPS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the number of them before each byte."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.r_[0, np.cumsum((data & 0xC0) != 0x80)]


def _runs(points: np.ndarray, step: np.unsignedinteger) -> np.ndarray:
    """A hash of the SHINGLE characters from each place on (at the end of fewer), in the type of step."""
    padded = np.r_[points, np.zeros(SHINGLE - 1, np.uint32)].astype(type(step), copy=False)
    h = padded[: len(points)] * step
    for k in range(1, SHINGLE):
        h += padded[k : len(points) + k]
        h *= step
    return h


def char_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of SHINGLE characters and the number up to each row's end; a shorter row is one run, an empty row none."""
    points, upto = _points(data)
    ends = upto[offsets]
    sizes = np.diff(ends)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    h = _runs(points, np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        h[ends[i]] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    whole = np.repeat(np.tile([True, False], len(sizes)), np.c_[counts, sizes - counts].ravel())
    return mix(h[whole]), np.r_[0, np.cumsum(counts)]


def signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key for each line data[start:end] and band; lines are in order, not empty, and cut at whole characters.

    The signature is a one-permutation MinHash: shingles fall into bins by hash, each bin keeps its least, and an empty bin
    takes the value of the first filled one in an order of its own, the same for all lines.
    """
    points, upto = _points(data)
    begin, end = upto[starts], upto[ends]
    counts = np.maximum(end - begin - SHINGLE + 1, 0)
    h = _runs(points, np.uint32(0x9E3779B1))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    rows, bins = len(starts), BANDS * ROWS
    between = np.r_[begin[:1], begin[1:] - begin[:-1] - counts[:-1], len(points) - begin[-1:] - counts[-1:]] if rows else np.array([len(points)])
    inside = np.repeat(np.r_[np.tile([False, True], rows), False], np.r_[np.c_[between[:-1], counts].ravel(), between[-1:]])
    h = h[inside]
    sig = np.full(rows * bins, _NONE, np.uint32)
    np.minimum.at(sig, np.repeat(np.arange(rows) * bins, counts) + ((h >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)), h * np.uint32(0x85EBCA77))
    for i in np.flatnonzero(counts == 0):
        sig[i * bins] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes()) & 0x7FFFFFFF
    sig = sig.reshape(rows, bins)
    filled = sig != _NONE
    least = sig.min(1)
    row, bin_ = np.nonzero(~filled)
    for probe in _PROBES[:_LOOP]:
        source = probe[bin_]
        found = filled[row, source]
        sig[row[found], bin_[found]] = sig[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]
    for k in range(0, len(row), _TOGETHER):
        r, b = row[k : k + _TOGETHER], bin_[k : k + _TOGETHER]
        turn = np.where(filled[r], _FIRST[b], np.uint16(len(_PROBES)))
        source = turn.argmin(1)
        met = turn[np.arange(len(r)), source] < len(_PROBES)
        sig[r, b] = np.where(met, sig[r, source], least[r])
    keys = np.zeros((rows, BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + sig.reshape(rows, BANDS, ROWS)[:, :, r])
    return mix(keys + _STEPS)


def band_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key for each row and band."""
    return signatures(data, offsets[:-1], offsets[1:])


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line_no, start, end) of every line that is not empty when white space at both ends is left out."""
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.r_[offsets[:-1], breaks + 1]), np.sort(np.r_[breaks, offsets[1:]])
    each = np.diff(np.searchsorted(breaks, offsets)) + 1
    row = np.repeat(np.arange(len(each)), each)
    line_no = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    solid = np.flatnonzero(~_SPACE[data])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = first < last
    return row[full], line_no[full], solid[first[full]], solid[last[full] - 1] + 1


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def _version(docs: DataFrame) -> Column:
    """What tells texts apart that share a doc_id: 31 bits of a hash of the text, or 0 if no doc_id is there twice."""
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return F.lit(0).cast("long") if twice.isEmpty() else F.coalesce(F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(0).cast("long"))


def signed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, version: Column | None = None) -> DataFrame:
    """(doc_id, place, h0, h1, size, keys): every line of every whole text, trimmed, of at least min_chars characters, by 128 bits of its digest, with its band keys.

    place is version * 2 ** 32 + the line's number.
    """

    def sign(batches):
        for batch in batches:
            for base, data, offsets in chunks(batch.column(1), STEP):
                row, line_no, starts, ends = lines_of(data, offsets)
                upto = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                size = upto[ends] - upto[starts]
                if min_chars > 1:
                    row, line_no, starts, ends, size = (x[size >= min_chars] for x in (row, line_no, starts, ends, size))
                raw = data.tobytes()
                halves = _halves([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                keys = signatures(data, starts, ends)
                at = pa.array(np.arange(len(row) + 1, dtype=np.int32) * (8 * BANDS)).buffers()[1]
                packed = pa.Array.from_buffers(pa.binary(), len(row), [None, at, pa.py_buffer(keys.tobytes())])
                columns = [batch.column(0).take(pa.array(row + base)), pa.array((batch.column(2).to_numpy()[row + base] << 32) + line_no), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(size.astype(np.int32)), packed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "h0", "h1", "size", "keys"])

    version = F.lit(0).cast("long") if version is None else version
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), version.alias("version"))
    return rows.mapInArrow(released(sign), "doc_id long, place long, h0 long, h1 long, size int, keys binary")


def line_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingles of each text."""
    out = []
    for _, data, offsets in chunks(column, STEP):
        h, upto = char_shingles(data, offsets)
        upto = upto.tolist()
        out += [distinct_sorted(h[a:b]) for a, b in zip(upto, upto[1:], strict=False)]
    return out


def line_groups(docs: DataFrame, num: int = 3, den: int = 4, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, group, kept, version) for every line of at least min_chars characters, trimmed; by default every line that is not empty.

    Lines are near duplicates when their character shingles have Jaccard similarity num / den or more;
    group is the 64-bit hash that names the component; kept is true for its first line in
    order of (doc_id, version, line_no). line_no counts from 0 over the text split at \\n. Rows with a null doc_id or text have no lines
    here (their texts stay as they are). version is 0 unless some doc_id is there twice; then it is a hash of the text, so unlike texts of one doc_id are documents of their own, and rows
    equal in doc_id and text are copies of one document and keep the same lines. Other columns are ignored; an empty table gives no rows.

    Equal lines collapse by 128 bits of their digest. Banding brings near ones into one bucket with a probability of 0.93 at similarity
    0.75, 0.98 at 0.8 and over 0.999 at 0.9. Nothing below the threshold is linked: all pairs of a bucket are counted exactly, on whole lines.
    A large bucket is dealt to several blocks; then each line outside its main component meets all lines of the other blocks (see bucket_links).
    All joins are by shuffle at every size, so that the plan does not change as the input grows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    signed = scratch.keep(signed_lines(docs, min_chars, _version(docs)), "signed")
    where = signed.select("doc_id", "place", "h0", "h1")
    shared = scratch.keep(shared_members(signed.select(F.col("h0").alias("id"), "size", "keys"), BANDS), "shared")
    members = scratch.keep(shared.distinct(), "members")
    scratch.drop("shared")
    ways = scratch.keep(bucket_ways(scratch, members), "ways")
    scratch.drop("members")
    ids = ways.select("id").distinct()
    firsts = scratch.keep(where.groupBy("h0", "h1").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("copies")), "firsts")
    asked = firsts.join(ids.hint("merge"), F.col("h0") == F.col("id"), "left_semi").groupBy(F.col("first.doc_id").alias("asked_id")).agg(F.collect_list(F.struct(F.col("first.place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("line_no"), "h0", "h1")).alias("asked"))
    texts = scratch.keep(_texts(docs, scratch.keep(asked, "asked")), "texts")

    # should two lines share h0, the one of the smaller h1 stands for it here, and the other is left out below
    payload = texts.select("id", F.col("h1").alias("tie"), F.col("text").alias("data"))
    links = bucket_links(scratch, ways, payload, line_sets, lambda x, y: -(-num * (x + y) // (num + den)))
    parts = components(scratch, links, "lines")
    own = firsts.select("h0", "h1").join(parts.hint("merge"), F.col("h0") == F.col("id")).groupBy("h0").agg(F.min("h1").alias("h1"), F.min("component").alias("component"))
    parts = scratch.keep(own, "parts")
    grouped = firsts.join(parts.hint("merge"), ["h0", "h1"], "left").where("copies > 1 or component is not null").select("h0", "h1", "first", F.coalesce("component", "h0").alias("group"), F.col("component").isNull().alias("lone"))
    grouped = scratch.keep(grouped, "grouped")
    lone = grouped.where("lone").select("h0", "h1", "group", F.col("first").alias("keeper"))
    keeper = grouped.where("not lone").groupBy("group").agg(F.min("first").alias("keeper"))
    decided = grouped.where("not lone").join(keeper.hint("merge"), "group").select("h0", "h1", "group", "keeper")
    decided = scratch.keep(lone.unionByName(decided), "decided")
    first = (F.col("keeper.doc_id") == F.col("doc_id")) & (F.col("keeper.place") == F.col("place"))
    line_no, version = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.shiftright("place", 32)
    return where.join(decided.hint("merge"), ["h0", "h1"], "left").select("doc_id", line_no.alias("line_no"), F.coalesce("group", "h0").alias("group"), F.coalesce(first, F.lit(True)).alias("kept"), version.alias("version"))


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, h1, text) of the lines that are asked for: asked(asked_id, asked: list of line_no, h0, h1)."""

    def read(batches):
        for batch in batches:
            for base, data, offsets in chunks(batch.column(0), STEP):
                row, line_no, starts, ends = lines_of(data, offsets)
                borders = np.searchsorted(row, np.arange(len(offsets)))
                raw = data.tobytes()
                ids, checks, texts = [], [], []
                for k, wanted in enumerate(batch.column(1).slice(base, len(offsets) - 1).to_pylist()):
                    x, y = borders[k], borders[k + 1]
                    place = x + np.searchsorted(line_no[x:y], [w["line_no"] for w in wanted])
                    for at, w in zip(place.tolist(), wanted, strict=True):
                        if at < y and line_no[at] == w["line_no"]:
                            text = raw[starts[at] : ends[at]]
                            if _halves([xxhash.xxh3_128_digest(text)])[0].tolist() == [w["h0"], w["h1"]]:  # not another row of the same doc_id
                                ids.append(w["h0"])
                                checks.append(w["h1"])
                                texts.append(text.decode())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(checks, pa.int64()), pa.array(texts, pa.string())], ["id", "h1", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("asked_id"), F.col("text").cast("string").alias("text")).where("asked_id is not null and text is not null")
    return rows.join(asked.hint("merge"), "asked_id").select("text", "asked").mapInArrow(released(read), "id long, h1 long, text string")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and kept flags of all lines of the table documents; see line_groups for nulls, empty and long texts, ties and repeated rows."""
    return line_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of the given numbers."""

    def cut(t, numbers):
        lines = t.split("\n")
        left = np.ones(len(lines), bool)
        left[numbers] = False
        return "\n".join(x for x, stays in zip(lines, left.tolist(), strict=True) if stays)

    return pa.array([None if g is None else cut(t, g) for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True)], pa.string())


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicate lines, short ones among them, the first stays; empty lines stay.

    A document left without text goes; n_chars follows the text of one that lost lines. Null and empty texts and rows with a null doc_id stay as they
    are; unlike texts that share a doc_id are documents of their own, rows equal in doc_id and text lose the same lines; an empty table stays empty; other columns pass through.
    """
    scratch = Scratch(spark, "lines-stage")
    with passing():  # of the groups only what goes is needed further on
        gone = line_groups(docs).where("not kept").groupBy(F.col("doc_id").alias("gone_id"), "version").agg(F.collect_set("line_no").alias("gone"))
        gone = scratch.keep(gone, "gone")
    version = _version(docs)
    rows = docs.select(F.struct("*").alias("row"), version.alias("own"))  # apart from the names that are used here
    joined = rows.join(gone, (F.col("row.doc_id") == F.col("gone_id")) & (F.col("own") == F.col("version")), "left").withColumn("cut", F.col("gone").isNotNull())
    joined = joined.withColumn("left", F.when(F.col("cut"), _without("row.text", "gone")).otherwise(F.col("row.text"))).where(~F.col("cut") | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    change = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col("cut"), F.length("left")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[change.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
