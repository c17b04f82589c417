"""Rules found from pages themselves: repeated tag paths of all hosts at once, scored, refined by a step in each of a few rounds, the best kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions.dom import Node, text_of
from weftlake.functions.urls import normal_host
from weftlake.operators.content import page_parts
from weftlake.operators.rules import _href, selector_issues
from weftlake.sources.state import shared_folder

#: Score from which a host's rule is good enough; rounds, each with selectors one step longer; items of a page that make a list.
GOOD, ROUNDS, LEAST_ITEMS, MOST_ITEMS = 80, 3, 3, 100
#: Elements and class parts that tell what a page is made of, classes that tell nothing.
SEMANTIC = ["article", "section", "main", "aside", "nav", "header", "footer", "h1", "h2", "h3"]
CONTENT_CLASSES = ["card", "article", "story", "post", "item", "entry", "headline", "title"]
PLAIN_CLASSES = ["container", "wrapper", "hidden", "active"]


def repeated_items(nodes: list[Node]) -> list[dict]:
    """Elements with text: the path of names from the body down, their text and link. A name is the tag with its first class, if that holds no digit."""
    out: list[dict] = []
    names: dict[int, list[str]] = {}
    for i, n in enumerate(nodes):
        if n.tag[0] == "#" or n.tag in ("html", "head", "body"):
            continue
        classes = [c for c in n.classes() if c.replace("-", "").replace("_", "").isalpha()]
        names[i] = [*names.get(n.parent, []), n.tag + (f".{classes[0]}" if classes else "")]
        text = text_of(nodes, i)
        if text:
            out.append({"path": names[i], "text": text, "href": _href(nodes, i)})
    return out


def candidates(items: DataFrame, steps: int) -> DataFrame:
    """(host, selector, score, ...) of the paths of `steps` names that repeat on pages: items(host, page_id, path, text, href).

    As for rules that are written by hand, the score is of count, links, length and good titles. It counts only so far as the path is on the host's pages and its texts differ from page to page, which menus' do not; brittle selectors lose points.
    """
    selector = F.array_join(F.slice("path", -steps, F.lit(steps)), " > ")
    rows = items.where(F.size("path") >= steps).withColumn("selector", selector)
    size = F.octet_length("text")
    good = size.between(10, 500) & (F.length(F.regexp_replace("text", r"[0-9.]", "")) > 5)
    pages = rows.groupBy("host", "selector", "page_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(F.col("href") != "").alias("linked"), F.count_if(good).alias("good"))
    listed = pages.where(F.col("n").between(LEAST_ITEMS, MOST_ITEMS)).groupBy("host", "selector").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("linked").alias("linked"), F.sum("good").alias("good"))
    # equal texts of a host and selector meet in one row before they are counted
    texts = rows.groupBy("host", "selector", F.xxhash64("text").alias("t")).agg(F.count("*").alias("k")).groupBy("host", "selector").agg(F.count("*").alias("different"), F.sum("k").alias("all"))
    whole = items.select("host", "page_id").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    found = listed.join(texts, ["host", "selector"]).join(whole, "host")
    share = lambda c: F.col(c) / F.col("n")
    quality = 30 * F.least(F.lit(1.0), F.col("n") / F.col("pages") / 10) + 30 * share("linked") + 20 * F.least(F.lit(1.0), share("bytes") / 30) + 20 * share("good")
    score = quality * (F.col("pages") / F.col("host_pages")) * (F.col("different") / F.col("all")) - 5 * F.size(selector_issues(F.col("selector")))
    passes = (share("bytes") >= 15) & (share("good") >= 0.5)
    return found.select("host", "selector", F.round(score, 6).alias("score"), (F.col("n") / F.col("pages")).alias("items"), share("linked").alias("link_ratio"), F.lit(steps).alias("steps")).where(passes)


def induce(pages: DataFrame, rounds: int = ROUNDS, good: float = GOOD) -> DataFrame:
    """(domain, articles, title, layout, score, steps): a list rule for each host of pages(page_id, url, html) that has one, for reading.read_pages.

    In each round the hosts without a good rule get selectors one step longer; of all rounds the best stays, of equal ones the shorter. What a round leaves is
    written to the shared folder, so a lost executor repeats a round at most, and plans do not grow. Pages are parsed once.
    """
    spark = pages.sparkSession
    base = f"{shared_folder(spark)}/induction-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    rows = pages.select("page_id", normal_host(F.col("url")).alias("host"), "html").where("host <> ''")
    made = page_parts(rows, ["items"], keep=("page_id", "host"), more={"items": (repeated_items, "array<struct<path:array<string>,text:string,href:string>>")})
    items = keep(made.select("page_id", "host", F.inline("items")), "items")
    best = spark.createDataFrame([], "host string, selector string, score double, items double, link_ratio double, steps int")
    for steps in range(1, rounds + 1):
        done = best.where(F.col("score") >= good).select("host")
        open_ = items.join(done, "host", "left_anti") if steps > 1 else items
        if open_.isEmpty():
            break
        found = best.unionByName(candidates(open_, steps))
        w = W.Window.partitionBy("host").orderBy(F.desc("score"), "steps", "selector")
        best = keep(found.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k"), f"best{steps}")
    layout = F.when(F.col("link_ratio") >= 0.3, "list").otherwise("text")
    return best.select(F.col("host").alias("domain"), F.col("selector").alias("articles"), F.lit("").alias("title"), layout.alias("layout"), "score", "steps")


def available_selectors(nodes: DataFrame) -> DataFrame:
    """(page_id, kind, value, n) of structure.page_nodes: what a rule for the page can go by. kind: testid (three times or more, the ten most frequent), element, part (of a class, three or more), class (10 to 100, the eight most frequent)."""
    top = lambda df, k: df.withColumn("k", F.row_number().over(W.Window.partitionBy("page_id").orderBy(F.desc("n"), "value"))).where(F.col("k") <= k).drop("k")
    counted = lambda kind, rows: rows.groupBy("page_id", "value").agg(F.count("*").alias("n")).select("page_id", F.lit(kind).alias("kind"), "value", "n")

    def valued(c: Column) -> DataFrame:
        return nodes.select("page_id", c.alias("value")).where("value is not null and value <> ''")

    class_ = F.coalesce(F.col("attrs")["class"], F.lit(""))
    parts = F.explode(F.filter(F.array(*[F.lit(c) for c in CONTENT_CLASSES]), lambda c: F.contains(class_, c)))
    testids = top(counted("testid", valued(F.col("attrs")["data-testid"])).where("n >= 3"), 10)
    elements = counted("element", nodes.where(F.col("tag").isin(*SEMANTIC)).select("page_id", F.col("tag").alias("value")))
    classes = top(counted("class", valued(F.explode("classes")).where(~F.lower("value").isin(*PLAIN_CLASSES))).where("n between 10 and 100"), 8)
    return testids.unionByName(elements).unionByName(counted("part", valued(parts)).where("n >= 3")).unionByName(classes)
