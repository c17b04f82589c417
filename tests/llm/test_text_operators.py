"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftlake.llm import common, edit_embedding, lang_id, license_scan, line_dedup, mixing, ngram_join, pieces

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "te", "so") for b in ("n", "r", "lo", "mi", "st", "ve", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near_copies(seed=1):
    rng = random.Random(seed)
    texts = []
    for size in (6, 9, 20, 60, 200):
        base = prose(rng, size).split()
        texts.append(" ".join(base))
        for _ in range(6):
            w = list(base)
            for _ in range(max(1, size // 40)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
        texts.append(" ".join(base).upper())
    return texts + ["one two", "one two", "ONE  two", "x", prose(rng, 8000)]


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(ids, sets, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if linked(sets[i], sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_ngram_join(spark, documents, no_documents):
    df = documents(near_copies()).withColumn("component", F.lit("clash")).withColumn("n", F.lit(1))
    rows = df.collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    want = brute_components([r.doc_id for r in rows], sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
    got = ngram_join.ngram_groups(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in want}
    assert ngram_join.ngram_groups(no_documents).count() == 0
    twice = df.unionAll(df)
    assert ngram_join.ngram_groups(twice).count() == 2 * len(rows)
    kept = ngram_join.near_distinct(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_ngram_null_id(spark, documents):
    got = ngram_join.ngram_groups(documents(["a b c d e f"], more=[(None, "a b c d e f", "en", "s", 11)])).where("doc_id is null").first()
    assert got.n_shingles == 2 and got.component_id is None


def test_line_dedup(spark, documents, no_documents):
    rng = random.Random(3)
    base = [prose(rng, 12) for _ in range(4)]
    texts = ["\n".join([base[0], base[1], "short"]), "\n".join(["  " + base[0] + "  ", "short", prose(rng, 12)]), base[0] + "x", base[2].replace(base[2][10], "q", 1), base[2], prose(rng, 4000)]
    df = documents(texts).withColumn("id", F.lit(0)).withColumn("line_no", F.lit("clash"))
    rows = {(r.doc_id, r.line_no): r for r in line_dedup.line_groups(df).collect()}
    lines = {(r.doc_id, k): x.strip(" \t\n\x0b\f\r") for r in df.collect() for k, x in enumerate((r.text or "").split("\n"))}
    lines = {k: v for k, v in lines.items() if len(v) >= line_dedup.MIN_CHARS}
    assert set(rows) == set(lines)
    grams = {k: {v[i : i + 5] for i in range(len(v) - 4)} for k, v in lines.items()}
    keys = sorted(lines)
    want = brute_components(keys, grams, lambda a, b: 4 * len(a & b) >= 3 * len(a | b))
    assert {k for k, r in rows.items() if r.kept} == {k for k in keys if want[k] == k}
    assert line_dedup.line_groups(no_documents).count() == 0
    out = line_dedup.without_repeats(spark, df, "")
    assert out.columns == df.columns
    texts_out = {r.doc_id: r for r in out.collect()}
    assert "short" not in texts_out[11].text and texts_out[11].n_chars == len(texts_out[11].text) and 12 not in texts_out and texts_out[10].text == texts[0] and {1, 2} <= set(texts_out)


def test_line_dedup_varied_groups(spark, documents):
    rng = random.Random(23)
    lines = []
    for _ in range(3):
        base = prose(rng, 20).split()
        for _ in range(200):
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(20)] = rng.choice(WORDS)
            lines.append(" ".join(w))
    lines = sorted(set(lines))
    got = [r for r in line_dedup.line_groups(documents(lines)).collect() if r.doc_id >= 10]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    keys = line_dedup.band_keys(data, np.r_[0, np.cumsum([len(x) for x in lines])])
    both = {i: (set(keys[i].tolist()), {x[k : k + 5] for k in range(len(x) - 4)}) for i, x in enumerate(lines)}
    want = brute_components(list(both), both, lambda a, b: bool(a[0] & b[0]) and 4 * len(a[1] & b[1]) >= 3 * len(a[1] | b[1]))
    assert {r.doc_id - 10 for r in got if r.kept} == {i for i in want if want[i] == i}


def test_short_lines(documents):
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_groups(documents(["Les.\nAnd ornd.\n\nx", " Les.\nx\nLex."])).collect()}
    assert {k for k in got if k[0] >= 10} == {(10, 0), (10, 1), (10, 3), (11, 0), (11, 1), (11, 2)}
    assert {k for k, r in got.items() if not r.kept} == {(11, 0), (11, 1)} and got[11, 0].group == got[10, 0].group


def language_rows():
    rng = random.Random(5)
    forms = {"aa": "the and ing tion".split(), "bb": "der und ung keit".split(), "cc": "les que eau ment".split()}
    return [(100 + k, " ".join(rng.choice(forms[c]) + rng.choice(forms[c]) for _ in range(rng.randint(3, 60))), c, "s", 0) for k in range(120) for c in [("aa", "bb", "cc")[k % 3]]]


def test_language_id(spark, documents, no_documents):
    df = documents([], more=[*language_rows(), (900, "der und " * 20000, None, "s", 0), (901, "12 34!", "aa", "s", 0)]).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: r for r in lang_id.identify(df).collect()}
    assert len(got) == df.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 900, 901)] == ["und", "und", "und", "und", "bb", "und"]
    truth = {r[0]: r[2] for r in language_rows()}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 10 and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert lang_id.identify(no_documents).count() == 0
    assert {r.lang_pred for r in lang_id.identify(documents(["no labels at all"], lang=None).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = lang_id.known_language(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.lang_pred != "und"}
    odd = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(950).cast("long")).withColumn("text", F.repeat(F.lit("qzx wvk jjq zzx "), 40))).withColumn("a.b", F.lit(1))
    kept = lang_id.known_language(spark, odd, "")
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.lang_pred != "und"}


def test_language_ties_and_many(spark, documents):
    """Equal posteriors give the first language; many languages share fewer buckets."""
    got = {r.doc_id: r for r in lang_id.identify(documents([], more=[(k, "abc abd", lang, "s", 0) for k in range(100, 140) for lang in ("yy", "xx")])).collect()}
    assert {r.lang_pred for i, r in got.items() if i >= 100} == {"xx"} and got[100].score == pytest.approx(0.5)
    assert [lang_id.bucket_count(n) for n in (0, 64, 65, 128, 129, 10**6)] == [1 << 16, 1 << 16, 1 << 15, 1 << 15, 1 << 14, 1 << 6]
    rows = [(1000 + k, f"w{'abcdefghijklmnopqrst'[k % 20]}{'abcdefghijklmnopqrst'[k // 20]} " * 5, f"l{k}", "s", 0) for k in range(100)]
    got = {r.doc_id: r for r in lang_id.identify(documents([], more=rows)).collect()}
    right = [got[r[0]].lang_pred == r[2] for r in rows if not got[r[0]].held_out]
    assert len(right) > 50 and np.mean(right) > 0.9


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(spark, documents, no_documents):
    rng = random.Random(7)
    more = [(1000 + k, prose(rng, rng.choice([1, 5, 80, 300])), "en", rng.choice(["big"] * 8 + ["mid", "tiny", None, "é"]), 0) for k in range(300)]
    more += [(2000, prose(rng, 9000), "en", "long", 0), (2001, "w", "en", "w", 0), (2001, "w", "en", "w", 0)]
    df = documents([], more=more).withColumn("target", F.lit("clash")).withColumn("offset", F.lit(1))
    rows = df.collect()
    got = mixing.mixture(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for r in rows:
        by_source[r.source] = by_source.get(r.source, 0) + size(r.text)
    want = brute_targets(by_source)
    source = {r.doc_id: r.source for r in rows}
    taken = dict.fromkeys(by_source, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by_source[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in by_source:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, mixing.mixture(df.repartition(7)).collect())) == sorted(map(tuple, got))
    assert mixing.mixture(no_documents).count() == 0
    out = mixing.mixed(spark, df, "")
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    assert {r.doc_id: r.taken for r in got if r.taken and r.doc_id != 2001} == {i: n for i, n in words.items() if i != 2001}


def test_mixing_keeps_rows_apart(spark, documents):
    text = prose(random.Random(9), 300)
    more = [(1000, text, "en", "s1", 0), (1000, text, "en", "s2", 0), (1000, text, "en", "s2", 0), (1000, text, "de", "s2", 0), (1001, text, "en", "s1", 0)]
    df = documents([], more=more).withColumn("row", F.lit("clash")).withColumn("k0", F.create_map(F.lit("a"), F.lit(1)))
    taken, words = {}, {}
    for r in mixing.mixture(df).collect():
        taken[r.doc_id, r.source_size] = taken.get((r.doc_id, r.source_size), 0) + r.taken
    out = mixing.mixed(spark, df, "")
    assert out.columns == df.columns and out.schema["k0"].dataType == df.schema["k0"].dataType
    sizes = {"s1": 600, "s2": 900}
    for r in out.where("source in ('s1', 's2')").collect():
        words[r.doc_id, sizes[r.source]] = words.get((r.doc_id, sizes[r.source]), 0) + len(r.text.split())
    assert {k: n for k, n in taken.items() if n and k[1] in (600, 900)} == words and len(words) == 3


def test_plan_of_the_mix_is_small(spark, documents):
    plan = mixing.mixture(documents(["a b c"]))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000 and "drawn" in plan and "shard" in plan


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"), F.col("id").alias("i"))
        got = got.select("i", "p", mixing._permuted_back(F.col("p"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("back")).collect()
        assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.i for r in got)


def test_shards_are_multinomial(spark, documents):
    docs = spark.range(1200).select("id", F.repeat(F.lit("w "), 64 * 32).alias("text"), F.when(F.col("id") < 60, "a").when(F.col("id") < 500, "b").otherwise("c").alias("source"))
    got = mixing.mixture(docs.withColumnRenamed("id", "doc_id")).select("doc_id", F.explode("places").alias("p")).select(F.when(F.col("doc_id") < 60, "a").when(F.col("doc_id") < 500, "b").otherwise("c").alias("source"), "p.*")
    slots = got.select("source", "shard", "slot").distinct().groupBy("shard", "source").count().collect()
    shards = max(r.shard for r in slots)  # the last one is not full
    assert shards >= 30
    for source in "abc":
        n = np.array([next((r["count"] for r in slots if (r.shard, r.source) == (k, source)), 0) for k in range(shards)])
        p = n.mean() / mixing.SHARD
        assert 0.6 < n.std() / np.sqrt(mixing.SHARD * p * (1 - p)) < 1.5


def test_pieces_match_library(spark, documents, no_documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(11)
    odd = ["  a  b ", "\n\n x\n", "é x\r\n\t y", "日本語 тест", " " * 40 + "z" + " " * 17, "aaaa aaaaa", "x" * 4000, "😀😀 .......,,,"]
    texts = odd + ["".join(rng.choice("abcdetion  \nñé.,!1 ") for _ in range(rng.randint(1, 300))) for _ in range(60)] + ["a▁b ▁ c"]
    df = documents(texts).withColumn("ids", F.lit("clash")).withColumn("k", F.lit(1))
    got = {r.doc_id: r for r in pieces.encode(df, check=True).collect()}
    for r in df.collect():
        if r.text is None:
            assert got[r.doc_id].ids is None and got[r.doc_id].n_tokens is None
            continue
        assert got[r.doc_id].round_trip and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)
        if "▁" not in r.text:
            assert got[r.doc_id].ids == lib.encode(r.text), r.text
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == {r.doc_id: r.text for r in df.collect()}
    assert pieces.encode(no_documents, check=True).count() == 0


def test_stream_is_bounded_and_unigram():
    model = {"bpe": False, "pieces": [("<unk>", 0.0, "u"), ("▁", -3.0, "n"), *[(c, -4.0, "n") for c in "abc"], ("ab", -5.0, "n"), ("bc", -4.5, "n"), ("abc", -9.0, "n"), ("ca", -5.5, "n")]}
    e = pieces.Encoder(model)
    scores = {p: s for p, s, _ in model["pieces"]}
    rng = random.Random(2)
    for n in (1, 3, 9, 300):
        t = "".join(rng.choice("abc") for _ in range(n))
        best = [0.0] + [-1e9] * n
        for i in range(1, n + 1):
            best[i] = max(best[j] + scores[t[j:i]] for j in range(max(0, i - 3), i) if t[j:i] in scores)
        assert sum(scores[model["pieces"][k][0]] for k in e.stream(t)) == pytest.approx(best[n])
        assert "".join(model["pieces"][k][0] for k in e.stream(t)) == t


def test_windows_agree_with_library(spark, no_documents):
    """Words of all lengths by arrays and one by one; the window of a stretch without a break stays small."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    e = pieces.Encoder(pieces.load_pieces())
    rng = random.Random(4)
    words = {"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 64))) for _ in range(400)} | {"a" * 60, "abab" * 15, "the" * 20, "zqxj" * 16}
    fine = sorted((w for w in words if e.single.issuperset(w)), key=len, reverse=True)
    memory = pieces.Words(e.word, 10_000)
    e._learn(memory, pieces.SPACE, fine)
    for w in fine:
        assert np.frombuffer(memory[w], np.int32).tolist() == e.word(pieces.SPACE + w) == lib.encode(w)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    assert e.word(pieces.SPACE + long) == lib.encode(long)
    assert pieces.decode(pieces.encode(no_documents)).count() == 0


@pytest.mark.parametrize("piece", ["a\u2581b", "\u2581\u2581a", "a\n"])
def test_models_that_cross_spaces_are_refused(tmp_path, piece):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces.add(piece=piece, score=-1.0, type=sentencepiece_model_pb2.ModelProto.SentencePiece.NORMAL)
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="crosses"):
        pieces.load_pieces(str(tmp_path / "m.model"))


def test_fingerprints(spark, documents, no_documents):
    rng = random.Random(13)
    texts = [prose(rng, n) for n in (3, 30, 300, 3000)] + ["same text here", "same text here", "é" * 50]
    more = [(None, "no id", "en", "s", 0)]
    df = documents(texts, more=more).withColumn("stretch", F.lit("clash")).withColumn("fingerprint", F.lit(1))
    got = edit_embedding.with_edits(df).collect()
    assert len(got) == df.count()
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 3
        edited = t[: len(t) - q] + nxt[:q]
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if len(t) > 100 and nxt[:q] != t[len(t) - q :]:
            assert r.near_edited > 0.5 > r.near_next
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[14] == prints[15] and prints[1] == prints[2] and len(set(prints.values())) == len({r.text or "" for r in df.collect()})
    assert edit_embedding.with_edits(no_documents).count() == 0
    assert edit_embedding.with_edits(no_documents.unionAll(spark.createDataFrame([(5, "abcdef", "en", "s", 6)], no_documents.schema))).first().near_edited <= 1
    assert all(r.near_id is None for r in got)


def test_fingerprint_classes(spark, documents, no_documents, tmp_path):
    rng = random.Random(31)
    texts = []
    for size in (20, 80, 400, 2500):
        for _ in range(3):
            base = prose(rng, size)
            for edits in (0, 0, 1, 1, 2, size // 30, size // 15):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = rng.choice(["", "zz", "q"])
                texts.append("".join(w))
    texts += [t[: len(t) // 2] + u[len(u) // 2 :] for t, u in zip(texts[::9], texts[4::9], strict=False)]
    df = documents(texts, more=[(10, texts[0], "en", "s", 0), (None, texts[0], "en", "s", 0)])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = edit_embedding.op4_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == df.count()
    sets = {r.doc_id: set(edit_embedding.marks(bytes.fromhex(r.fingerprint)).tolist()) for r in got if r.doc_id is not None}
    near = {r.doc_id: r.near_id for r in got if r.doc_id is not None}
    linked = lambda a, b: a == b or bool(a) and bool(b) and 4 * len(a & b) >= 3 * max(len(a), len(b))
    want = brute_components(sorted(sets), sets, linked)
    links = [(i, j) for i in sets for j in sets if i < j and linked(sets[i], sets[j])]
    assert len(links) > 100 and np.mean([near[i] == near[j] for i, j in links]) >= 0.9
    assert all(want[i] == want[near[i]] and near[i] <= i for i in near) and next(r for r in got if r.doc_id is None).near_id == 10
    prints = {r.doc_id: bytes.fromhex(r.fingerprint) for r in got if r.doc_id is not None}
    for i, j in links[:50]:
        assert edit_embedding.likeness(prints[i], prints[j]) >= 0.75
    assert edit_embedding.near_classes(no_documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).count() == 0


def test_licenses(spark, documents, no_documents):
    rng = random.Random(17)
    texts = ["The MIT License, and the mit-license!", "Apache License MIT License", "GNU General Public License", prose(rng, 5000) + "\nLicensed under CC BY-NC 4.0.\n" + prose(rng, 50), "released under mit", "submit license", "mit license mit license", prose(rng, 200)]
    texts += ["The studio released its new film last spring under several names and asked the city for a license to film in the park.", "His driving license was lost; the new one was issued under a new scheme that the office released in the same year."]
    df = documents(texts).withColumn("labels", F.lit("clash")).withColumn("block", F.lit(1))
    templates = spark.createDataFrame(license_scan.TEMPLATES, "label string, words string")
    got = license_scan.scan(df.unionAll(df), templates).collect()
    assert len(got) == 2 * df.count()
    by = {r.doc_id: r for r in got}
    for r in df.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, said, more = [], set(), {}
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            own = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += own
            said |= {label} if own else set()
        for label, t in license_scan.TEMPLATES:
            s, n = set(t.split()), len(t.split())
            for k in range(0, max(len(w), 1), n):
                share = len(s & set(w[k : k + 2 * n])) / len(s)
                if 5 * len(s & set(w[k : k + 2 * n])) >= 4 * len(s):
                    more[label] = max(more.get(label, 0), share)
        g = by[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert (g.base_labels, g.labels) == (",".join(sorted(said)), ",".join(sorted(said | set(more))))
        assert g.score == pytest.approx(1.0 if at else max(more.values(), default=0.0))
    assert "cc-by-nc" in by[13].labels and by[18].labels == by[19].labels == ""
    assert license_scan.scan(no_documents, templates).count() == 0


def test_pipeline(spark, tmp_path, documents):
    rng = random.Random(19)
    rows = [(500 + k, "\n".join(prose(rng, 30) for _ in range(3)), "en", f"s{k % 3}", 0) for k in range(40)]
    rows += [(600, rows[0][1], "en", "s0", 0), (601, rows[1][1].replace("ban", "bam", 1), "en", "s1", 0)]
    documents([], more=rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{k}.parquet"))
            docs = spark.read.parquet(str(tmp_path / f"{k}.parquet"))
            ids = {r.doc_id for r in docs.collect()}
            assert k or ids == {r[0] for r in rows}
            assert k == 0 or 600 not in ids
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert final and all(r.n_tokens == len(r.ids) > 0 for r in final) and {r.doc_id for r in final} <= {r[0] for r in rows}


def test_signing_in_few_calls():
    """Bins that few shingles leave empty are settled at once: the calls do not grow with the probes it takes, and values come from the first filled bin in the bin's own order."""
    rng = np.random.default_rng(3)
    lines = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)).encode() for n in [1, 4, 5, 6, 7, 9, 20, 60, 400] * 20]
    data, ends = np.frombuffer(b"".join(lines), np.uint8), np.cumsum([len(x) for x in lines])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    starts = ends - [len(x) for x in lines]
    line_dedup.signatures(data, starts, ends)  # what is loaded at first use does not count
    sys.setprofile(count)
    try:
        keys = line_dedup.signatures(data, starts, ends)
    finally:
        sys.setprofile(None)
    assert calls < 400  # 228, and 478 when each probe was a turn of the loop
    for k, line in enumerate(lines[:9]):
        own = line_dedup.signatures(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line)]))
        assert (own[0] == keys[k]).all()
    few = line_dedup._FIRST
    assert all(few[b, s] == next((k for k, p in enumerate(line_dedup._PROBES) if p[b] == s), len(line_dedup._PROBES)) for b in range(0, 50, 7) for s in range(50))


def test_shuffles_go(spark):
    """Scratch tables are kept with the setting by which the files of their shuffles do not stay beside them."""
    common.Scratch(spark, "shuffles")
    assert spark.conf.get(common.SHUFFLES_GO) == "true"
