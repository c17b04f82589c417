"""Op 11: how five filters interact, from one SQL CUBE over their failure flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch

#: The filters' letters; bit i of a subset's mask stands for letter i.
LETTERS = "ABCDE"
ALL = (1 << len(LETTERS)) - 1
#: A counted property of the surviving documents, by the name of its column.
COUNTS = ("n", "good", "toxic")
_SPACE = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D): conditions on the document's own text; a null text counts as empty. Every row of docs gives a row.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * characters A-Z > 10 * code points; D: holds any of # $ % & * |.
    Words are runs without ASCII white space, case-sensitive. part is the lang, '' where it is null; digest is the text's SHA-256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    parts = F.split("text", _SPACE)  # empty before a leading and after a trailing run of white space
    rows = rows.select("doc_id", "part", "text", parts.alias("w"))
    ends = F.when(F.element_at("w", 1) == "", 1).otherwise(0) + F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    rows = rows.select("doc_id", "part", "text", F.size("w").alias("n"), ends.alias("ends"), F.size(F.array_distinct("w")).alias("d"))
    words, distinct = F.col("n") - F.col("ends"), F.col("d") - F.least(F.col("ends"), F.lit(1))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (words < 100).alias("A"),
        (100 * distinct.cast("long") < 80 * words.cast("long")).alias("B"),
        (100 * capitals.cast("long") > 10 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A..E, n, good, toxic): documents counted by part and the filters that they fail.

    E: the text is identical to that of a smaller doc_id, anywhere in the table. A row with a null doc_id never fails E, nor makes another row fail it;
    rows that share the smallest doc_id of a text all pass. good and toxic count documents with a label quality = 1 or toxic = 1; of several labels of a doc_id one
    is enough. The rows are joined by (digest, doc_id) and by doc_id, so a text that a third of all documents share is dealt out like any other.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows = scratch.keep(failures(docs), "failures")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    rows = rows.join(firsts.hint("merge"), ["digest", "doc_id"], "left")
    rows = rows.withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("digest", "first")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks.hint("merge"), "doc_id", "left")
    return rows.groupBy("part", *LETTERS).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTS[1:]])


def survivors(counted: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): what passes all filters of each subset, from the CUBE's rows whose selected flags are all false; subsets without survivors have no row.

    counted(part, A..E, n, good, toxic) has at most 32 rows a part, so the 64 grouping sets are of that table, not of the documents.
    """
    cube = counted.cube("part", *LETTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("gid"))
    of_parts = cube.where(F.col("gid") < 1 << len(LETTERS))  # part is the first of the columns, so the highest bit; a grouping bit is set where a column is not selected
    passed = [F.coalesce(~F.col(c), F.lit(True)) for c in LETTERS]
    mask = sum((F.when(F.col("gid").bitwiseAND(1 << (len(LETTERS) - 1 - i)) == 0, 1 << i).otherwise(0) for i in range(len(LETTERS))), F.lit(0))
    alive = passed[0]
    for p in passed[1:]:
        alive = alive & p
    return of_parts.where(alive).select("part", mask.cast("int").alias("mask"), *COUNTS)


def _orders() -> Column:
    """Steps of all orders: (filter_order, step, letter, before, after) with the subsets applied before and after the step."""
    steps = []
    for order in permutations(LETTERS):
        mask = 0
        for k, letter in enumerate(order, 1):
            bit = LETTERS.index(letter)
            steps.append(f"struct('{''.join(order)}' as filter_order, {k} as step, {bit} as letter, {mask} as before, {mask | 1 << bit} as after)")
            mask |= 1 << bit
    return F.expr(f"array({', '.join(steps)})")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order of the five filters and step.

    See flagged() for nulls, ties and repeated rows. Other columns are ignored; an empty table has no parts and gives no rows; a step that removes nothing has zeros.
    A step joins the survivors of two subsets, those of the filters before it and with it; the same pairs, of the empty set and the filter alone and of
    all others and all, give what fails the filter and what fails it only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "interactions")
    alive = scratch.keep(survivors(scratch.keep(flagged(docs, labels), "flagged")), "survivors")
    parts = alive.where("mask = 0").select("part")
    steps = parts.select("part", F.explode(_orders()).alias("s")).select("part", "s.*")
    bit = F.pow(F.lit(2), F.col("letter")).cast("int")
    pairs = {"before": F.col("before"), "after": F.col("after"), "alone": bit, "others": F.lit(ALL) - bit, "none": F.lit(0), "all": F.lit(ALL)}
    for name, mask in pairs.items():
        of = alive.select(F.col("part"), F.col("mask").alias(f"{name}_mask"), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])
        steps = steps.withColumn(f"{name}_mask", mask).join(of, ["part", f"{name}_mask"], "left")
    left = lambda name, c="n": F.coalesce(f"{name}_{c}", F.lit(0))
    removed = left("before") - left("after")
    steps = scratch.keep(
        steps.select(
            "part", "filter_order", "step", "letter", left("after").alias("kept"), removed.alias("removed"), (left("none") - left("alone") - removed).alias("redundant"), (left("others") - left("all")).alias("unique_fails"),
            (left("before", "good") - left("after", "good")).alias("good_lost"), (left("before", "toxic") - left("after", "toxic")).alias("toxic_lost"),
        ),
        "steps",
    )
    shapley = steps.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley, ["part", "letter"]).drop("letter")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all rows of the table documents, with the table labels; see interactions for all cases."""
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by text) as lo from t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > lo, false)] as fails
  from w left join l using (doc_id)),
o(filter_order) as (select '' union all select filter_order || c from o, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(c) where length(filter_order) < 5 and not contains(filter_order, c)),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
s as (select part, filter_order, step, ascii(filter_order[step]) - 64 as k, fails, n, good, toxic,
  fails[ascii(filter_order[step]) - 64] as own, len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 as earlier, len(list_filter(fails, lambda x: x)) as many
  from c, o, (select unnest(range(1, 6)) as step) where length(filter_order) = 5),
r as (select part, filter_order, step::int as step, any_value(k) as k, coalesce(sum(n) filter (not own and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (own and not earlier), 0)::bigint as removed,
  coalesce(sum(n) filter (own and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (own and many = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (own and not earlier), 0)::bigint as good_lost, coalesce(sum(toxic) filter (own and not earlier), 0)::bigint as toxic_lost
  from s group by part, filter_order, step)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, k))::bigint as shapley from r
"""
