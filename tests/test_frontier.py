"""The frontier against a plain set, with small filters that err and repeated batches; records of unlike rules stored and read by path."""

import random

from pyspark.sql import functions as F

from weftlake.operators import frontier, records

FOUND = "url string, host string, priority int, depth int, found_from string"


def test_frontier(spark, tmp_path):
    rng = random.Random(1)
    own = frontier.Frontier(spark, str(tmp_path / "f"), buckets=4, words=4)  # 256 bits a bucket: many mistakes
    seen, looked = set(), []
    real = own.seen.lookup
    own.seen.lookup = lambda wanted: looked.append({r.url for r in wanted.collect()}) or real(wanted)
    for batch in range(3):
        rows = [(f"u{rng.randint(0, 150)}", "h", rng.randint(0, 3), 0, f"s{rng.randint(0, 2)}") for _ in range(80)] + [(None, "h", 0, 0, "s")]
        df = spark.createDataFrame(rows, FOUND)
        want = {}
        for r in sorted(r for r in rows if r[0] is not None and r[0] not in seen):
            if r[0] not in want or (r[2], r[3], r[4]) < want[r[0]]:
                want[r[0]] = (r[2], r[3], r[4])
        got = {r.url: (r.priority, r.depth, r.found_from) for r in own.enqueue(df, batch).collect()}
        assert got == want
        assert {r[0] for r in rows if r[0] in seen} <= looked[-1] and (batch or looked[-1] == set())  # nothing seen escapes the exact check
        seen |= want.keys()
        assert {r.url for r in own.enqueue(df, batch).collect()} == want.keys() and own.seen.read().count() == len(seen)
    wide = frontier.Frontier(spark, str(tmp_path / "w"), buckets=4)
    wide.enqueue(spark.createDataFrame([(f"u{k}", "h", 0, 0, "s") for k in range(500)], FOUND), 0)
    fresh = wide.sift(spark.createDataFrame([(f"v{k}", "h", 0, 0, "s") for k in range(500)] + [("u7", "h", 0, 0, "s")], FOUND))
    assert [r.url for r in fresh.where("maybe").collect()] == ["u7"]  # only it meets the exact check


def test_turns(spark):
    rows = [(f"{h}{k}", h, k % 2, 0, "s") for h, n in (("a", 5), ("b", 1)) for k in range(n)]
    got = sorted((r.turn, r.url) for r in frontier.turns(spark.createDataFrame(rows, FOUND), 3).collect())
    assert got == [(1, "a0"), (1, "b0"), (2, "a2"), (3, "a4")]


def test_links(spark, tmp_path):
    own = frontier.Frontier(spark, str(tmp_path / "f"), buckets=2)
    links = spark.createDataFrame([("https://A.com/x", 1), ("/rel", 1), (None, 1), ("http://b.org", 2)], "href string, depth int")
    assert {(r.url, r.host) for r in frontier.enqueue_links(own, links, 0, F.col("depth") * 2, "page").collect()} == {("https://A.com/x", "a.com"), ("http://b.org", "b.org")}


def test_variants(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.com/", "<h1>T</h1><ul><li><a href='/x'>X</a><li>Y</ul>"), (2, "https://b.com/", "<h2>U</h2><p>one<p>two"), (3, "https://c.com/", "<p>none"), (4, "https://a.com/", "<p>no match")], "page_id int, url string, html string")
    rules = {"a": {"Title": "h1", "List": "li[]", "List.text": "a"}, "b": {"Head": "h2", "Paragraphs": "p[]"}}
    which = F.when(F.contains("url", F.lit("a.com")), "a").when(F.contains("url", F.lit("b.com")), "b")
    records.variant_records(pages, rules, which, {"title": ["Title", "Head"]}).write.parquet(str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    assert dict(got.dtypes)["record"] == "variant"
    read = got.select("page_id", "rule", "title", F.try_variant_get("record", "$.List[0].href", "string").alias("href"), records.many(F.col("record"), "$.Paragraphs", "string").alias("paragraphs"))
    assert sorted(map(tuple, read.collect())) == [(1, "a", "T", "/x", None), (2, "b", "U", None, ["one", "two"])]
    assert records.variant_records(pages, {}, which, {"title": ["Title"]}).count() == 0
