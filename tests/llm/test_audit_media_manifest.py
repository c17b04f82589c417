"""Ops 11 to 13 against brute force: filter interactions, Ogg media, Merkle manifest; nulls, ties, repeated rows, long texts, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from weftlake.llm import filter_audit, merkle, ogg

WORDS = "alpha Beta gamma DELTA eps zeta eta theta iota kappa".split()


# ---- filter interactions -----------------------------------------------------------------------


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    least = {}
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    rows = []
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r.doc_id is not None and r.doc_id > least[t],
        }
        rows.append((r.lang or "", {f for f in fails if fails[f]}, r.doc_id in good and r.doc_id is not None, r.doc_id in toxic and r.doc_id is not None))
    out, shapley = {}, collections.Counter()
    for part in {p for p, *_ in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in own)
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def test_filter_interactions(spark, documents, no_documents):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(120))
    texts = [long, long, long + " #", "SHOUT " * 120, " ".join(rng.choice(WORDS) for _ in range(150)), "\t a  b\n", "A" * 10 + "b" * 90, "é" * 89 + "A" * 10, long * 40, " ".join(f"v{k}" for k in range(100)), " ".join(f"v{k}" for k in range(99))]
    more = [(40, long, None, None, 3), (40, long, "", None, 3), (None, long, "fr", "s", 3), (None, None, "fr", "s", 3), (7, " ".join(f"v{k}" for k in range(99)), "de", "s", 1)]
    df = documents(texts, more=more).withColumn("part", F.lit("clash")).withColumn("A", F.lit(True)).withColumn("digest", F.lit("x"))
    labels = [(10, 1, 0), (11, 0, 1), (12, 1, 1), (12, 0, 0), (13, None, None), (None, 1, 1), (40, 1, None), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    want = brute_audit(df.collect(), labels)
    got = filter_audit.interactions(df, marks).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want and len(got) == len(want) == 600 * 4
    assert all(v is not None for r in got for v in r)
    twice = filter_audit.interactions(df.unionAll(df), marks).collect()
    want = brute_audit(df.collect() * 2, labels)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in twice} == want
    assert filter_audit.interactions(no_documents, marks).count() == 0
    assert {r.good_lost for r in filter_audit.interactions(df, marks.limit(0)).collect()} == {0}


# ---- media --------------------------------------------------------------------------------------


def brute_crc(page):
    r = 0
    for b in page[:22] + b"\0\0\0\0" + page[26:]:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def brute_packets(media):
    """Data packets by serial, and pages, read in the plainest way."""
    at, pages, open_, out = 0, 0, {}, collections.defaultdict(list)
    while at < len(media):
        assert media[at : at + 4] == b"OggS"
        n = media[at + 26]
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        serial, seq, crc = struct.unpack_from("<III", media, at + 14)
        assert crc == brute_crc(media[at:end])
        body = at + 27 + n
        for size in lacing:
            open_[serial] = open_.get(serial, b"") + media[body : body + size]
            body += size
            if size < 255:
                out[serial].append(open_.pop(serial))
        at, pages = end, pages + 1
    assert not open_
    return {s: p[2:] for s, p in out.items()}, pages


@pytest.mark.parametrize("n", [64, 1024, 1088, 255 * 64, 64 * 1000])
def test_ogg_pages(n):
    payload = random.Random(n).randbytes(n)
    media = ogg.write_media(payload)
    packets, pages = brute_packets(media)
    streams, found, bad = ogg.read_media(media)
    assert (found, bad) == (pages, 0) and {s.serial: [p for p, _, _ in s.packets] for s in streams} == packets
    assert ogg.samples(streams) == payload and ogg.write_media(payload) == media
    assert b"".join(x for pair in itertools.zip_longest(*packets.values(), fillvalue=b"") for x in pair) == payload
    for s in streams:
        assert [end for _, end, _ in s.packets] == list(itertools.accumulate(len(p) for p, _, _ in s.packets))


def test_ogg_packet_sizes():
    """Packets of all kinds of sizes, whole multiples of 255 and empty ones among them, over few segments a page."""
    rng = random.Random(2)
    for lacing in (1, 3, 255):
        packets = [rng.randbytes(k) for k in (5, 9, 255, 0, 510, 254, 256, 1, 2000, 765)]
        ends = list(itertools.accumulate(map(len, packets)))
        media = b"".join(ogg.stream_pages(list(zip(packets, ends, strict=True)), 7, lacing))
        s = ogg.Stream(7)
        for page in ogg.read_pages(media):
            assert page.fine and len(page.lacing) <= lacing
            s.take(page)
        assert [p for p, _, _ in s.packets] == packets and [e for _, e, _ in s.packets] == ends and s.lost == 0


def test_ogg_damage():
    payload = random.Random(1).randbytes(64_000)
    media = ogg.write_media(payload)
    whole, pages, _ = ogg.read_media(media)
    hurt = bytearray(media)
    hurt[30_000] ^= 4
    streams, n, bad = ogg.read_media(bytes(hurt))
    assert bad == 1 and n == pages and sum(s.lost for s in streams) == 1
    for s, w in zip(streams, whole, strict=True):
        assert set(s.packets) <= set(w.packets)  # what is left keeps its time
    assert ogg.samples(ogg.read_media(b"noise" + media + b"more")[0]) == payload
    assert ogg.read_media(None) == ([], 0, 0) and ogg.read_media(b"OggS") == ([], 0, 0) and ogg.samples(ogg.read_media(media[:20_000])[0]) != b""
    foreign = b"".join(ogg.stream_pages([(b"\x01vorbis", 0), (b"TRACK=x/y", 0), (b"abc", 9)], 1))
    assert [s.packets for s in ogg.read_media(foreign)[0]] == [[]]


def test_media_columns(spark, documents, no_documents):
    texts = ["x" * 64, "é" * 32, "a\x00b", "same", "same", "long \U0001f600 " * 60_000]
    df = documents(texts, more=[(10, texts[0], "en", "s", 1), (None, "same", None, None, None)]).withColumn("media", F.lit(1)).withColumn("key", F.lit(2))
    stored = ogg.media_of(df).cache()
    got = ogg.media_features(stored).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for r in rows:
        raw = (r.text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        g = by_id[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert f"us={max(sum(len(full[k : k + 1024]) for k in range(t * 1024, len(full), 2048)) for t in (0, 1)) * 125}" in g.feature.split(";")
        assert f"sum={sum(full) - 128 * len(full)}" in g.feature.split(";") and "bad=0;lost=0" in g.feature
    media = {r.doc_id: r.media for r in stored.collect()}
    assert all(by_id[i].media_sha256 == hashlib.sha256(m).hexdigest() and by_id[i].media_bytes == len(m) for i, m in media.items())
    same = [tuple(g)[1:] for g in got if g.doc_id in (13, 14, None)]
    assert len(same) == 3 and len(set(same)) == 1
    packets = ogg.packets_of(stored.where("doc_id = 15")).collect()
    raw = texts[5].encode() + bytes(-len(texts[5].encode()) % 64)
    assert b"".join(bytes(p.data) for p in sorted(packets, key=lambda p: (p.start_us, p.track))) == raw and {p.track for p in packets} == {0, 1}
    assert all(p.end_us - p.start_us == len(p.data) * 125 for p in packets)
    assert ogg.media_features(ogg.media_of(no_documents)).count() == 0


# ---- manifest -----------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute_tree(nodes):
    """(root, steps of each node)."""
    steps, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for own, at in zip(steps, place, strict=True):
            run, k = runs[at // 3], at % 3
            own.append(("".join(run[:k]), "".join(run[k + 1 :])))
        place = [at // 3 for at in place]
        nodes = [sha(*run) for run in runs]
    return nodes[0], steps


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[b"" if r.source is None else b"1" + r.source.encode()].append((r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text), r))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    trees = {k: brute_tree([x[2] for x in groups[k]]) for k in sorted(groups)}
    root, upper = brute_tree([t[0] for t in trees.values()])
    out = []
    for above, k in zip(upper, sorted(groups), strict=True):
        for (_, _, leaf, r), own in zip(groups[k], trees[k][1], strict=True):
            steps = own + above
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = brute_leaf(r, r.text.replace("\n", "") if hit and r.text is not None else r.text)
            for left, right in steps:
                node = sha(left, node, right)
            out.append((r.doc_id, leaf, trees[k][0], root, sha(*(a + b for a, b in steps)), node, node == root))
    return out


def manifest(df):
    return merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.regexp_replace("text", "\n", ""))


def key(r):
    return tuple(str(x) for x in r)


def test_manifest(spark, documents, no_documents):
    rng = random.Random(3)
    rows = [(k, f"text {k}\nline" if k % 3 else None, rng.choice(["en", None]), rng.choice(["a", "b", "é", "z", None, ""]), rng.choice([k, None])) for k in range(100, 400)]
    rows += [(1000 + k, "hot\n", "en", "hot", k) for k in range(1500)]  # three pages of one source
    rows += [(5, "same\nrow", "en", "a", 1)] * 5 + [(None, "no\nid", None, "a", 2), (None, None, None, None, None), (3, "alone", "en", "only", 5), (2, "x" * 300_000 + "\n", "en", "z", 1)]
    df = documents([], more=rows).withColumn("grp", F.lit("clash")).withColumn("pos", F.lit(0)).withColumn("leaf", F.lit(0))
    got = manifest(df).collect()
    want = brute_manifest(df.collect())
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({r.root for r in got}) == 1 and {r.verified for r in got} == {True, False}
    assert manifest(no_documents).count() == 0
    one = manifest(df.where("source = 'only'")).collect()
    assert [tuple(r) for r in one] == brute_manifest(df.where("source = 'only'").collect()) and one[0].leaf == one[0].root and one[0].proof_sha256 == sha("")
    for n in (2, 3, 4, 9, 10, 28):
        part = df.where(f"source = 'hot' and doc_id < {1000 + n}")
        assert sorted(map(key, manifest(part).collect())) == sorted(map(key, brute_manifest(part.collect())))


def test_manifest_pages(spark, documents, monkeypatch):
    """Small pages, so that both trees have several storeys."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "PAGE", 3)
    rows = [(k, f"t{k}\n", "en", f"s{k % 11 if k % 2 else 0}", k) for k in range(150)]
    df = documents([], more=rows)
    got = manifest(df)
    assert sorted(map(key, got.collect())) == sorted(map(key, brute_manifest(df.collect())))
    assert {r.verified for r in merkle.manifest(df).collect()} == {True}
