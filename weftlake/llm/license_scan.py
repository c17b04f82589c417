"""Op 7 [native]: license scans by an exact containment join of word sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.llm.common import small

#: Phrases that always count, and what they say.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Templates: label and the words of a notice.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]
_WORD, _BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text with one space between them; A-Z are lower-cased, a null is empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is quicker than translate(), but turns more than A-Z
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.btrim(F.regexp_replace(low, _BETWEEN, " "))


def _places(joined: Column, phrase: str) -> Column:
    """Word indices at which a phrase starts; joined has a space before, between and after the words."""
    parts = F.split(joined, f" {phrase}(?= )")  # a phrase never overlaps itself
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    n = len(phrase.split())
    starts = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("found")),
        lambda acc, x: F.struct((acc["at"] + spaces(x) + n).cast("long").alias("at"), F.concat(acc["found"], F.array((acc["at"] + spaces(x)).cast("long"))).alias("found")),
        lambda acc: acc["found"],
    )
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), starts).otherwise(F.array().cast("array<long>"))


def scan(docs: DataFrame, templates: DataFrame, threshold: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    templates(label, words): a block of text meets a template when it holds at least num / den of the
    template's distinct words. A template of n words is held against blocks of 2 n words that start at every n-th word of the whole
    text, so every stretch of n + 1 words lies within one, and words that stand further apart do not meet. Words of templates are ordered by
    the number of documents that hold them, over all documents; a block is a candidate if it holds a
    word of the template's rare-first prefix, then length and position bounds, then the exact count. The score is 1 where a phrase stands, else the
    best containment that was met, else 0. A null text is empty; repeated rows are scanned each; an empty table gives no rows. Only derived
    numbers and the words around a rare word are shuffled, never texts, and by whole rows, so no key is hot.
    """
    num, den = threshold
    rows = docs.select(F.col(key).alias("key"), spaced(F.col(text)).alias("spaced"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), "spaced", F.lit(" ")))
    listed = [(r.label, r.words) for r in templates.select("label", "words").distinct().orderBy("label", "words").limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1,000 templates; they are literals of the plan")
    longest = max((len(t.split()) for _, t in listed), default=1)
    vocabulary = sorted({w for _, t in listed for w in t.split()})

    # global order: document frequency of the templates' words
    seen = F.array_distinct(F.regexp_extract_all("joined", F.lit(f"(?<= )(?:{'|'.join(vocabulary) or '(?!)'})(?= )"), F.lit(0)))
    counted = rows.select(F.explode(seen).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    order = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string").join(F.broadcast(counted), "word", "left")
    order = order.select("word", (F.row_number().over(W.Window.orderBy(F.coalesce("df", F.lit(0)), "word")) - 1).alias("rank"))
    ranks = {r.word: r.rank for r in order.collect()}
    prefixes = []
    for label, t in listed:
        own = sorted(set(t.split()), key=ranks.get)
        need = -(-num * len(own) // den)
        prefixes += [(w, label, own, len(own), need, p, len(t.split())) for p, w in enumerate(own[: len(own) - need + 1])]
    index = docs.sparkSession.createDataFrame(prefixes, "prefix string, label string, own array<string>, size int, need int, at int, step int")

    base = rows
    for i, (phrase, _) in enumerate(PHRASES):
        base = base.withColumn(f"p{i}", _places(F.col("joined"), phrase))
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    said = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())))
    rare = sorted({p[0] for p in prefixes})
    # around each rare word the words that blocks of any template with it can hold
    place = F.transform(F.split("spaced", " "), lambda x, i: F.when(x.isin(rare), F.struct(x.alias("prefix"), i.cast("int").alias("at_word"))))
    first = lambda r: F.greatest(F.lit(0), r["at_word"] - 2 * longest)
    near = lambda w: F.transform(F.filter(place, lambda x: x.isNotNull()), lambda r: F.struct(r["prefix"].alias("prefix"), r["at_word"].alias("at_word"), first(r).alias("first"), F.slice(w, first(r) + 1, 4 * longest).alias("around")))
    found = F.get(F.transform(F.array(F.split("spaced", " ")), near), F.lit(0))
    holds = F.col("joined").rlike(f" (?:{'|'.join(rare)}) ") if rare else F.lit(False)
    base = base.select(
        "key",
        F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), said.alias("said"), F.when(holds, found).alias("found"),
    )
    columns = base.columns
    base = base.groupBy(*columns).agg(F.count("*").alias("copies"))
    tried = base.withColumn("place", F.explode_outer("found")).withColumn("prefix", F.col("place.prefix"))
    met = tried.join(small(index), "prefix", "left")
    # the two blocks of the template that hold the place
    later = F.col("place.at_word") - F.pmod(F.col("place.at_word"), F.col("step"))
    met = met.withColumn("start", F.explode_outer(F.filter(F.array(later, later - F.col("step")), lambda x: x >= 0)))
    words = F.slice("place.around", F.col("start") - F.col("place.first") + 1, 2 * F.col("step"))
    # a block is told by its template words alone, in the global order
    ordered = F.array(*[F.lit(w) for w in sorted(vocabulary, key=ranks.get)]) if vocabulary else F.array().cast("array<string>")
    met = met.withColumn("block", F.array_intersect(ordered, words))
    here = F.array_position("block", F.col("prefix")) - 1
    bound = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("block") - here - 1) + F.least("at", here)
    common = F.size(F.array_intersect("block", "own"))
    hit = F.when((F.size("block") >= F.col("need")) & (bound >= F.col("need")) & (common >= F.col("need")), F.struct(F.col("label"), (common / F.col("size")).alias("share")))
    found = met.groupBy(*columns, "copies").agg(F.collect_set(hit["label"]).alias("more"), F.max(hit["share"]).alias("share"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("said", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("said", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and templates in all documents; see scan for nulls, empty and long texts, ties and repeated rows."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.createDataFrame(TEMPLATES, "label string, words string"))


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))}, {len(t.split())})" for label, t in TEMPLATES)
    places = ", ".join(f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: w[i+1:i+{len(p.split())}] = {quoted(p.split())}) as p{n}" for n, (p, _) in enumerate(PHRASES))
    said = ", ".join(f"case when len(p{n}) > 0 then '{label}' end" for n, (_, label) in enumerate(PHRASES))
    every = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    return f"""
with w as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
t(label, s, l) as (values {templates}),
b as (select k, label, s, w[f+1:f+2*l] as b from (select k, w, label, s, l, unnest(range(0, greatest(len(w), 1), l)) as f from w, t)),
h as (select k, label, len(list_filter(s, lambda x: list_contains(b, x))) as n, len(s) as m from b),
m as (select k, list(distinct label) as more, max(n / m) as share from h where 5 * n >= 4 * m group by k),
p as (select k, doc_id, w, {places} from w),
q as (select k, doc_id, len(w) as n, {every} as places, list_filter([{said}], lambda x: x is not null) as said from p)
select doc_id, n::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word, array_to_string(list_sort(said), ',') as base_labels,
  array_to_string(list_sort(list_distinct(said || coalesce(more, []))), ',') as labels, case when len(places) > 0 then 1.0 else coalesce(share, 0.0) end::double as score from q left join m using (k)
"""


SQL = _sql()
