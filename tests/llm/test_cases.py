"""Repeated rows, ties, empty tables and clashing columns through operators and stages; recall of the line banding."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftlake.llm import common, edit_embedding, lang_id, line_dedup, ngram_join, pieces, vector_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASHES = ["row", "left", "gone", "gone_id", "cut", "k0", "spans", "k", "ids", "stretch", "component_id", "size", "lang_pred"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def clashing(documents):
    rng = random.Random(1)
    texts = [prose(rng, 40) for _ in range(6)]
    more = [(30, texts[0], "en", "s", 5), (30, texts[0], "en", "s", 5), (None, texts[1], "en", None, 5), (None, None, None, None, None)]
    df = documents(texts, more=more)
    for k, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(k))
    return df


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, clashing, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, clashing, "")
    rows = out.collect()
    if stage == corpus_pipeline.STAGES[-1][0]:
        assert len(rows) == clashing.count() and {r.doc_id for r in rows} == {r.doc_id for r in clashing.collect()}
    else:
        assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
        assert {r.doc_id for r in rows} <= {r.doc_id for r in clashing.collect()} and all(r[c] == k for r in rows for k, c in enumerate(CLASHES))
    assert run(spark, clashing.limit(0), "").count() == 0


def test_line_stage_on_ties(spark, documents):
    text = prose(random.Random(2), 30)
    out = {r.doc_id: r for r in line_dedup.without_repeats(spark, documents([f"{text}\n{text}\n{text}x", text, "own words only here, not too short"]), "").collect()}
    assert out[10].text == text and out[10].n_chars == len(text) and 11 not in out and 12 in out


def test_stages_on_shared_ids(spark, documents):
    """Unlike texts under one doc_id are documents of their own."""
    rng = random.Random(8)
    own, text = prose(rng, 40), prose(rng, 40)
    more = [(31, f"{prose(rng, 30)}\nShared line of the text", "en", "s", 1), (30, "Shared line of the text", "en", "s", 1), (31, "one line", "en", "s", 1), (31, "a line\nother line here\nthe third one, alone", "en", "s", 1)]
    out = line_dedup.without_repeats(spark, documents([], more=more), "").where("doc_id >= 30").collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((i, t.replace("\nShared line of the text", "")) for i, t, *_ in more)
    kept = ngram_join.near_distinct(spark, documents([], more=[(3, text, "en", "s", 1), (5, text, "en", "s", 1), (5, own, "en", "s", 1)]), "")
    assert sorted((r.doc_id, r.text) for r in kept.where("n_chars = 1").collect()) == [(3, text), (5, own)]


def test_repeated_rows(spark, documents):
    rng = random.Random(3)
    df = documents([prose(rng, 30), prose(rng, 50)])
    twice = df.unionAll(df)
    for made in (lambda d: line_dedup.line_groups(d), lambda d: edit_embedding.with_edits(d), lambda d: lang_id.identify(d), lambda d: pieces.encode(d, check=True)):
        once, both = made(df).collect(), made(twice).collect()
        assert len(both) == 2 * len(once) and {r[0] for r in both} == {r[0] for r in once}
    kept = collections.Counter((r.doc_id, r.line_no) for r in line_dedup.line_groups(twice).collect() if r.kept)
    assert set(kept.values()) == {2}


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.1], 1), (1, [1.0, 0.0, 0.1], 1), (2, [1.0, 0.0, 0.11], 1), (3, [0.0, 1.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 2), (0, [0.0, 1.0, 0.01], 2)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(0, 1, 0, True), (1, 1, 0, False), (1, 2, 0, False), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)]


def test_hot_vectors(spark, monkeypatch):
    """A group larger than a block, counted across blocks."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(k, (base + 0.05 * rng.standard_normal(32)).tolist(), 1) for k in range(60)] + [(100 + k, rng.standard_normal(32).tolist(), 1) for k in range(60)]
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = ((x @ x.T) >= 0.98).sum(1) - 1
    assert n[:60].min() > 30 and [got[i].n_links for i, _, _ in rows] == n.tolist() and {got[k].component_id for k in range(60)} == {0}


def dense_and_off_centre():
    """Tables of (vectors, labels): one dense group, families about an offset, isotropic families, and a dense group among isotropic vectors."""
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(32)
    dense = lambda n: centre + 0.05 * rng.standard_normal((n, 32)) * np.linalg.norm(centre) / 5.6
    family = lambda n, spread: np.repeat(spread * rng.standard_normal((n, 32)), 3, axis=0) + 0.06 * spread * rng.standard_normal((3 * n, 32))
    yield "dense", dense(600), 0.5
    yield "off-centre", 2 * rng.standard_normal(32) + family(400, 0.3), 0.01
    yield "isotropic", family(400, 1.0), 0.0
    yield "dense fifth", np.vstack([dense(120), family(160, 1.0)]), 0.0
    yield "dense half", np.vstack([dense(300), family(100, 1.0)]), 0.0
    core = centre + rng.standard_normal((500, 32)) * rng.uniform(0.001, 0.2, (500, 1))  # pairs on opposite sides of the mean
    yield "core", core, 0.1


@pytest.mark.parametrize("name, x, share", list(dense_and_off_centre()), ids=lambda v: v if isinstance(v, str) else "")
def test_recall_of_vectors(spark, name, x, share):
    """All links against brute force, whatever the data's mean."""
    x = x[:1200]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    want = near.sum(1) - 1
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert want.sum() >= share * len(x) ** 2 and want.sum() > 500
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_many_dimensions(spark, monkeypatch):
    """Dimensions beyond those that rotations are learned for."""
    monkeypatch.setattr(vector_dedup, "LEARNED", 2)
    rng = np.random.default_rng(1)
    rows = [(10 * d + k, v.tolist(), 1) for d in (1, 2, 5, 9, 12) for v in [rng.standard_normal(d)] for k in range(2)]
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(spark.createDataFrame([(i, [c * (1 + i % 2) for c in v], lab) for i, v, lab in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: 1 for i, _, _ in rows}


def test_large_buckets(spark, documents, monkeypatch):
    """Buckets of several blocks lose no link that one block would find."""
    rng = random.Random(6)
    base = [prose(rng, 25).split() for _ in range(2)]
    lines = []
    for k in range(160):
        w = list(base[k % 2])
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        lines.append(" ".join(w))
    df = documents(lines)
    group = lambda: {r.doc_id: r.group for r in line_dedup.line_groups(df).collect()}
    whole = group()
    monkeypatch.setattr(common, "BLOCK", 20)
    assert group() == whole


def test_empty_pipeline(spark, no_documents, tmp_path):
    no_documents.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_recall_of_lines(spark):
    """All pairs of lines of the table from 0.75 on, by prefix filtering, against the groups that the banding finds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    where = {}
    for r in docs.where("text is not null").select("doc_id", "text").collect():
        for k, line in enumerate(r.text.split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                where.setdefault(line.strip(" \t\n\x0b\f\r"), (r.doc_id, k))
    sets = {x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in where}
    often = collections.Counter(g for s in sets.values() for g in s)
    index, pairs = collections.defaultdict(list), {}
    for x in sorted(sets, key=lambda x: len(sets[x])):
        own = sorted(sets[x], key=lambda g: (often[g], g))
        seen = set()
        for g in own[: len(own) - -(-3 * len(own) // 4) + 1]:
            seen.update(y for y in index[g] if 4 * len(sets[y]) >= 3 * len(own))
            index[g].append(x)
        for y in seen:
            both = len(sets[x] & sets[y])
            share = both / (len(sets[x]) + len(sets[y]) - both)
            if share >= 0.75:
                pairs[y, x] = share
    group = {(r.doc_id, r.line_no): r.group for r in line_dedup.line_groups(docs).collect()}
    found = {p: group[where[p[0]]] == group[where[p[1]]] for p in pairs}
    low = [found[p] for p, share in pairs.items() if share < 0.8]
    assert len(pairs) > 200 and len(low) > 20 and np.mean(low) >= 0.9 and np.mean(list(found.values())) >= 0.95
    up = {x: x for x in where}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    by_group = collections.defaultdict(set)
    for x, at in where.items():
        by_group[group[at]].add(root(x))
    assert all(len(v) == 1 for v in by_group.values())  # nothing is joined that no chain of pairs joins
