"""Documents as laid out: section numbers, heights and positions, matches, runs of links, chat prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions.text import ascii_words, byte_prefix, occurrences


def section_numbers(headings: DataFrame, key: str = "page_id", order: str = "ord") -> DataFrame:
    """headings(key, order, level) with number: n. for a main heading, n.m and n.m.k below it, m. where no main one came before.
    A third-level heading without a second-level one before it in its section has none."""
    w = lambda *keys: W.Window.partitionBy(key, *keys).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    one = lambda level: F.sum(F.when(F.col("level") == level, 1).otherwise(0))
    rows = headings.withColumn("__h1", one(1).over(w())).withColumn("__h2", one(2).over(w("__h1"))).withColumn("__h3", one(3).over(w("__h1", "__h2")))
    a, b, c = (F.col(x).cast("string") for x in ("__h1", "__h2", "__h3"))
    dot = F.lit(".")
    number = (
        F.when(F.col("level") == 1, F.concat(a, dot))
        .when(F.col("level") == 2, F.when(F.col("__h1") > 0, F.concat(a, dot, b)).otherwise(F.concat(b, dot)))
        .when((F.col("level") == 3) & (F.col("__h2") > 0), F.when(F.col("__h1") > 0, F.concat(a, dot, b, dot, c)).otherwise(F.concat(b, dot, c)))
    )
    return rows.withColumn("number", number).drop("__h1", "__h2", "__h3")


def line_height(kind: Column, lines: Column) -> Column:
    """Rows that a content node takes in the page's height."""
    return F.when(kind == "heading1", lines + 3).when(kind.isin("heading2", "heading3"), lines + 2).when(kind.isin("paragraph", "blockquote", "code_block", "list"), lines + 1).when(kind == "hr", F.lit(2)).otherwise(F.lit(1))


def with_positions(nodes: DataFrame, key: str = "page_id", order: str = "ord", titled: str | None = None) -> DataFrame:
    """nodes(key, order, height) with y: the sum of heights before, from 3 under a title, else 1."""
    before = W.Window.partitionBy(key).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    start = F.when(F.col(titled), 3).otherwise(1) if titled else F.lit(1)
    return nodes.withColumn("y", start + F.coalesce(F.sum("height").over(before), F.lit(0)))


def content_heights(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    return nodes.groupBy(key).agg(F.sum("height").alias("height"))


def find_matches(positioned: DataFrame, needle: str, key: str = "page_id", order: str = "ord") -> DataFrame:
    """(key, match, y): every occurrence of needle, numbered through the page."""
    rows = positioned.withColumn("__n", occurrences(F.col("text"), needle)).where("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    w = W.Window.partitionBy(key).orderBy(order, "__k")
    return rows.select(key, (F.row_number().over(w) - 1).alias("match"), "y")


def anchor_position(positioned: DataFrame, ident: str, key: str = "page_id", order: str = "ord") -> DataFrame:
    """(key, y) of the first node with an id on each page. Anchors themselves take no row here."""
    return positioned.where(F.col("id") == ident).groupBy(key).agg(F.min(F.struct(order, "y")).alias("m")).select(key, F.col("m.y").alias("y"))


def link_runs(spans: DataFrame, key: str = "page_id", order: str = "ord") -> DataFrame:
    """(key, run, href, text): neighbouring spans with the same address become one link."""
    w = W.Window.partitionBy(key).orderBy(order)
    fresh = F.coalesce(F.lag("href").over(w) != F.col("href"), F.lit(True))
    rows = spans.withColumn("__new", F.when(fresh, 1).otherwise(0)).withColumn("run", F.sum("__new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    rows = rows.groupBy(key, "run", "href").agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("s"))
    return rows.where("href <> ''").select(key, "run", "href", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))


def without_repeats(items: Column) -> Column:
    """An array with elements equal to the one before them left out."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)))


def in_columns(items: Column, n: int) -> Column:
    """Array of texts as lines of n items."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / n).cast("int") - 1), lambda k: F.array_join(F.slice(items, k * n + 1, n), "  "))


def jump_labels(count: int, exclude: str = "jkx") -> list[str]:
    """Distinct labels of one letter if they suffice, else of two."""
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz" if c not in exclude]
    return letters[:count] if count <= len(letters) else [a + b for a in letters for b in letters][:count]


def word_occurrences(docs: DataFrame, least: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, y, x, word): runs of ASCII letters of each line; y is the line, x the word's place among those of the line."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("y", "line"))
    return lines.select(key, "y", F.posexplode(ascii_words(F.col("line"), least)).alias("x", "word"))


def word_groups(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word, n, first_y): each document's words with their number and first line."""
    return words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("y").alias("first_y"))


def chat_prompts(turns: DataFrame, most: int = 100_000) -> DataFrame:
    """(conv_id, prompt): turns in order as 'role: text' lines, cut at a number of bytes between characters."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return rows.select("conv_id", byte_prefix(F.array_join(F.transform("t", lambda x: x["line"]), "\n"), most).alias("prompt"))
