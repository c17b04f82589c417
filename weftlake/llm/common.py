"""Shared parts: scratch tables, connected components, text kernels, verification of pairs and of whole buckets."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.sources.state import bounded_batches, shared_folder

#: Rows up to which a two-long table may be broadcast (24 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Bytes of text that a Python kernel holds at once, besides one longer text.
CHUNK_BYTES = 1 << 18


#: The session's setting by which the files of a query's shuffles go when it has ended: what is kept is in scratch tables, so none is read again.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_passing: list[list] = []


class Scratch:
    """Intermediate tables in the folder that spark.checkpoint.dir names, so they outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/weftlake-{name}-{uuid.uuid4().hex}"
        bounded_batches(spark)
        spark.conf.set(SHUFFLES_GO, "true")
        for opened in _passing:
            opened.append(self)

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing():
    """Removes all scratch tables that were begun inside, at its end: for results that are written there."""
    opened: list[Scratch] = []
    _passing.append(opened)
    try:
        yield
    finally:
        _passing.remove(opened)
        for scratch in opened:
            scratch.drop("")


#: What a module keeps in each worker between tasks, by name: how to drop it.
kept_in_workers: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def released(kernel, keeps: str = ""):
    """A kernel for mapInArrow that gives its memory back when it ends: workers live on, and their freed buffers would stay beside the next stage's.

    Before it begins, what other modules keep in the worker goes; only what `keeps` names stays.
    """

    def run(batches):
        for name, drop in kept_in_workers.items():
            if name != keeps:
                drop()
        try:
            yield from kernel(batches)
        finally:
            _give_back()

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with pos, the place from 0 on within the group by order, and m, the group's size. order must tell all rows apart.

    Rows are sorted by ranges into runs and written; a run's rows count from its first, and the runs before are counted in a table of a row for each group and run. So a
    group of any size is spread over tasks.
    """
    runs = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    runs = scratch.keep(runs, f"{name}-runs").withColumn("run", F.shiftright("at", 33))
    heads = runs.groupBy(group, "run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = W.Window.partitionBy(group)
    heads = heads.select(group, "run", "first", (F.sum("n").over(whole.orderBy("run")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("m"))
    heads = scratch.keep(heads, f"{name}-heads")
    return runs.join(small(heads), [group, "run"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "run", "first", "before")


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) of every id on an edge (a, b); component is the smallest id reachable.

    Union-find by contraction: every node hooks to its smallest neighbour, paths are halved until all
    point to a root, edges are rewritten between roots, and so on until none is left. Hot nodes are
    pre-aggregated before each shuffle, or sit on the side of a join that AQE can split.
    """
    edges = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    parts, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("up")), f"{name}-tree{turn}")
        step = 0
        while True:
            above = tree.select(F.col("id").alias("up"), F.col("up").alias("top"))
            new = scratch.keep(tree.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), (F.col("top") < F.col("up")).alias("moved")), f"{name}-tree{turn}-{step}")
            tree, step = new.select("id", "up"), step + 1
            if new.where("moved").isEmpty():
                break
        for side in ("a", "b"):
            edges = edges.join(tree.select(F.col("id").alias(side), F.col("up").alias(f"{side}_up")), side).drop(side).withColumnRenamed(f"{side}_up", side)
        turn += 1
        edges = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges{turn}")
        if parts is None:
            parts = tree
        else:
            parts = scratch.keep(parts.join(tree.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("up")), f"{name}-parts{turn}")
    if parts is None:
        return scratch.spark.createDataFrame([], "id long, component long")
    return parts.select("id", F.col("up").alias("component"))


# ---- text kernels ------------------------------------------------------------------------------

#: An odd multiplier, its inverse mod 2**64, and the weights of a shingle's five words.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_W = np.array([0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xF58B3A4CE2D1A6B5, 0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB], dtype=np.uint64)
_SPACES = (32, 9, 10, 11, 12, 13)
_VALUE = np.array([0 if b in _SPACES else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept between batches."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)], dtype=np.uint64) for p in (_P, _P_INV)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) over a string column, some rows at a time; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lower-cased, split at ASCII white space) and the number of words up to each row's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = powers(n)
    value = _VALUE[data]
    word = value != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] |= word[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return mix(np.add.reduceat(value * up[:n], at) * down[at]), np.searchsorted(at, offsets, "left")


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, and the number up to each row's end. A row of fewer words is one shingle; one without words has none."""
    words, upto = word_hashes(data, offsets)
    counts = np.diff(upto)
    if not len(words):
        return words, np.zeros(len(offsets), np.int64)
    total = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        total[: len(words) - k] += words[k:] * _W[k]
    row = np.repeat(np.arange(len(counts)), counts)
    left = upto[1:][row] - np.arange(len(words))  # words from here to the row's end
    whole = left >= width
    out = total[whole]
    out_row = row[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.array([(words[upto[r] : upto[r + 1]] * _W[: counts[r]]).sum(dtype=np.uint64) + np.uint64(counts[r]) for r in short], np.uint64)
        out, out_row = np.r_[out, own], np.r_[out_row, short]
        order = np.argsort(out_row, kind="stable")
        out, out_row = out[order], out_row[order]
    return mix(out), np.r_[0, np.cumsum(np.bincount(out_row, minlength=len(counts)))]


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; quicker than numpy.unique on short arrays."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


# ---- verification of pairs -----------------------------------------------------------------------


#: Members of a set from which the suffix filter is worth its cost.
FILTERED = 4096


def overlap(x: np.ndarray, y: np.ndarray, need: int) -> int:
    """Size of the intersection of two sorted sets, or -1 when a suffix filter shows it is below need.

    The suffix filter cuts both sets at the same pivots; the differences in size of the parts bound
    their Hamming distance from below.
    """
    if len(x) > len(y):
        x, y = y, x
    if len(x) < need:
        return -1
    if len(x) > FILTERED:
        pivots = y[len(y) // 16 :: max(1, len(y) // 16)]
        d = np.searchsorted(x, pivots) - np.searchsorted(y, pivots)
        apart = abs(d[0]) + np.abs(d[1:] - d[:-1]).sum() + abs(len(x) - len(y) - d[-1])
        if len(x) + len(y) - apart < 2 * need:
            return -1
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


#: Members, and bytes or characters of members, of a bucket that are held against each other in one place.
BLOCK, BLOCK_SIZE = 1024, 2_000_000
#: Members whose keys are sorted at once.
SORTED = 1 << 15


def _linked(ids: list[int], sets: list[np.ndarray], need) -> list[tuple[int, int]]:
    """Edges that span the components of all pairs of sorted sets whose intersections, counted exactly, reach need(size, size)."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    if n <= 16:
        edges, root = [], list(range(n))
        for i in range(1, n):
            for j in range(i):
                if root[i] != root[j]:
                    least = int(need(sizes[i], sizes[j]))
                    if least and overlap(sets[i], sets[j], least) >= least:
                        edges.append((ids[i], ids[j]))
                        gone, stays = max(root[i], root[j]), min(root[i], root[j])
                        root = [stays if r == gone else r for r in root]
        return edges
    flat, counts = np.unique(np.concatenate(sets), return_counts=True)
    flat = flat[counts > 1]
    both = np.zeros((n, n), np.float32)
    wide = max(256, (8 << 20) // n)
    for at in range(0, len(flat), wide):
        part = flat[at : at + wide]
        held = np.zeros((n, len(part)), np.float32)
        for i, s in enumerate(sets):
            own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
            place = np.searchsorted(part, own)
            held[i, place[part[place] == own]] = 1
        both += held @ held.T
    least = need(sizes[:, None], sizes[None, :])
    near = (both >= least) & (least > 0)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], n).min(1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(ids[i], ids[label[i]]) for i in range(n) if label[i] != i]


def _block_links(rows: DataFrame, sets_of, need) -> DataFrame:
    """(a, b): edges that span the links within each block. rows(block..., id, data) are dealt and sorted by block and id; a second row of an id is left out."""

    def check(batches):
        def settle(ids, data):
            edges = [0, *[i for i in range(1, len(ids)) if ids[i][0] != ids[i - 1][0]], len(ids)]
            sets = sets_of(pa.array(data))
            found = [e for x, y in zip(edges, edges[1:], strict=False) for e in _linked([i[1] for i in ids[x:y]], sets[x:y], need)]
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        ids: list[tuple] = []
        data: list = []
        size = 0
        for batch in batches:
            last = batch.num_columns - 1
            blocks = zip(*(batch.column(i).to_pylist() for i in range(last - 1)), strict=True)
            for block, ident, own in zip(blocks, batch.column(last - 1).to_pylist(), batch.column(last).to_pylist(), strict=True):
                if ids and ids[-1][0] != block:
                    if size > BLOCK_SIZE // 4:
                        yield settle(ids, data)
                        ids, data, size = [], [], 0
                elif ids and ids[-1][1] == ident:
                    continue
                ids.append((block, ident))
                data.append(own)
                size += len(own)
        if ids:
            yield settle(ids, data)

    return rows.mapInArrow(released(check), "a long, b long")


def shared_members(rows: DataFrame, bands: int) -> DataFrame:
    """(key, id, size), some twice, of the members that share a key with another one. rows(id, size, keys): keys are the 64-bit keys of all bands in one binary.

    Of members that meet in one batch only one goes on to the key's place, so a key that very many of them
    share is counted before the shuffle; there rows pass in order of keys and none is held. The members of a key need no order: one that comes back after another is out twice.
    """
    schema = "key long, id long, size int, sure boolean"
    names = ["key", "id", "size", "sure"]

    def distinct(key, ident, *more):
        order = np.lexsort((ident, key))
        key, ident = key[order], ident[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])] if len(key) else np.zeros(0, bool)
        return (key[new], ident[new], *(x[order][new] for x in more))

    def spread(batches):
        def flush(held):
            ident, size = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            key = np.frombuffer(b"".join(x[2] for x in held), np.int64)
            key, ident, size = distinct(key, np.repeat(ident, bands), np.repeat(size, bands))
            first = np.r_[True, key[1:] != key[:-1]]
            alone = first & np.r_[first[1:], True]
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(ident[first]), pa.array(size[first]), pa.array(np.zeros(first.sum(), bool))], names)
            yield pa.RecordBatch.from_arrays([pa.array(key[~alone]), pa.array(ident[~alone]), pa.array(size[~alone]), pa.array(np.ones((~alone).sum(), bool))], names)

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), b"".join(batch.column(2).to_pylist())))
                n += batch.num_rows
            if n >= SORTED:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def meet(batches):
        held = None  # the last row, and whether it is out already
        for batch in batches:
            if not batch.num_rows:
                continue
            sure = batch.column(3).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(sure))
            key, ident, size = (batch.column(i).to_numpy()[~sure] for i in range(3))
            if held is not None:
                key, ident, size = np.r_[held[0], key], np.r_[held[1], ident], np.r_[held[2], size].astype(np.int32)
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])]
            key, ident, size = key[new], ident[new], size[new]
            same = key[1:] == key[:-1]
            met = np.r_[same, False] | np.r_[False, same]
            out = met.copy()
            if held is not None and held[3]:
                out[0] = False
                met[0] = True
            held = (key[-1], ident[-1], size[-1], bool(met[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(ident[out]), pa.array(size[out]), pa.array(np.ones(out.sum(), bool))], names)

    place = F.when(F.col("sure"), F.xxhash64("id")).otherwise(F.col("key"))
    return rows.select("id", "size", "keys").mapInArrow(released(spread), schema).repartition(place).sortWithinPartitions("key").mapInArrow(released(meet), schema).select("key", "id", "size")


def bucket_ways(scratch: Scratch, members: DataFrame) -> DataFrame:
    """(key, block, id, blocks): where each member of a bucket goes. members(key, id, size), each once.

    Often the same members share several buckets; one of each set of members is enough.
    """
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("digest"), F.min("id").alias("low")).where("n > 1")
    buckets = buckets.groupBy("n", "digest", "low").agg(F.min("key").alias("key"), F.first("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SIZE), F.lit(1)).cast("int")
    buckets = scratch.keep(buckets.select("key", F.least(blocks, F.col("n").cast("int")).alias("blocks")), "buckets")
    return members.join(buckets.hint("merge"), "key").select("key", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int").alias("block"), "id", "blocks")


def bucket_links(scratch: Scratch, ways: DataFrame, payload: DataFrame, sets_of, need) -> DataFrame:
    """(a, b): links that join what all links between members of the same bucket join. ways: a kept table of bucket_ways.

    payload(id, tie, data): sets_of turns an array of data into sorted sets, and two members link when their sets share
    need(size, size) or more. All pairs of a block are counted exactly, without a row for any. A bucket of several blocks
    costs as much as its members first; then, components known, each member outside the bucket's main component meets all
    members of the other blocks, in blocks again. Of several rows of an id the one of the least tie counts.
    """
    sent = ways.join(payload.hint("merge"), "id").repartition("key", "block").sortWithinPartitions("key", "block", "id", "tie")
    links = scratch.keep(_block_links(sent.select("key", "block", "id", "data"), sets_of, need), "links")
    large = ways.where("blocks > 1")
    if large.isEmpty():
        return links
    parts = components(scratch, links, "first")
    large = scratch.keep(large.join(parts.hint("merge"), "id", "left").select("key", "block", "id", "blocks", F.coalesce("component", "id").alias("part")), "large")
    main = large.groupBy("key", "part").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "part")).alias("m"), F.sum("k").alias("n"), F.max("k").alias("k"))
    turns = F.ceil((F.col("n") - F.col("k")) / BLOCK).cast("int")
    main = scratch.keep(main.where("k < n").select("key", F.col("m.part").alias("main"), turns.alias("turns")), "main")
    open_ = large.join(main.hint("merge"), "key")
    stay = open_.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id")
    go = open_.where("part <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(11)), F.col("turns")).cast("int").alias("turn"), "id")
    sent = stay.unionByName(go).join(payload.hint("merge"), "id").repartition("key", "block", "turn").sortWithinPartitions("key", "block", "turn", "id", "tie")
    return links.unionByName(scratch.keep(_block_links(sent.select("key", "block", "turn", "id", "data"), sets_of, need), "links-large"))


def verify(scratch: Scratch, pairs: DataFrame, texts: DataFrame, tokens, num: int, den: int, per_task: int = 512, broadcast: bool = True) -> DataFrame:
    """The pairs (a, b) whose token sets have den * |intersection| >= num * |union|.

    texts: (id, text); tokens: list of texts -> list of sorted arrays. Each text goes once to each
    partner it is held against: members travel to their centre b, in salted groups of at most about
    per_task, so a centre with very many partners is spread out; the centre's text comes first. With
    broadcast, texts find their ways by broadcast where those are few, else always by shuffle.
    """
    spread = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / per_task).cast("int").alias("salts"))
    salted = pairs.join(spread, "b").select("a", "b", F.pmod(F.xxhash64("a", F.lit(7)), F.col("salts")).cast("int").alias("salt"))
    ways = salted.select(F.col("a").alias("id"), F.col("b").alias("centre"), "salt", F.lit(1).alias("role")).unionByName(
        salted.select("b", "salt").distinct().select(F.col("b").alias("id"), F.col("b").alias("centre"), "salt", F.lit(0).alias("role"))
    )
    ways = scratch.keep(ways, f"ways-{uuid.uuid4().hex[:8]}")
    sent = texts.where(F.col("id").isNotNull()).join(small(ways) if broadcast else ways.hint("merge"), "id").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")

    def check(batches):
        key, sets = None, []
        for batch in batches:
            a, b = [], []
            rows = batch.num_rows
            centre, salt, role, ident = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("centre", "salt", "role", "id"))
            text = batch.column(batch.schema.get_field_index("text"))
            for start in range(0, rows, 256):
                part = tokens(text.slice(start, 256))
                for i in range(start, min(rows, start + 256)):
                    if key != (centre[i], salt[i]):
                        key, sets = (centre[i], salt[i]), []
                    mine = part[i - start]
                    if role[i] == 0:
                        sets.append(mine)
                        continue
                    for other in sets:
                        both = len(mine) + len(other)
                        need = -(-num * both // (num + den))
                        if both and overlap(mine, other, need) >= need:
                            a.append(ident[i])
                            b.append(centre[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sent.select("id", "centre", "salt", "role", "text").mapInArrow(released(check), "a long, b long")
