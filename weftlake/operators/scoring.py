"""Judging what rules extract: scores, summaries, titles, answers of a rule writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions.text import byte_prefix, trimmed
from weftlake.operators.rules import selector_issues

#: Fixed values.
LEAST_ITEMS = 3
MENU_WORDS = ["home", "contact", "about", "login", "sign up", "menu", "section", "news", "sport", "business", "weather", "culture"]
LINK_HEAVY = ["news.ycombinator.com", "lobste.rs", "reddit.com", "bbc.com", "cnn.com", "theguardian.com", "nytimes.com", "reuters.com", "apnews.com"]
NEWS_WORDS = ["news", "times", "post", "daily", "herald", "tribune"]
TITLE_MENU = ["home", "about", "contact", "menu", "search", "login", "register"]
SITE_NAMES = {
    "news.ycombinator.com": "Hacker News", "lobste.rs": "Lobsters", "www.reddit.com": "Reddit", "reddit.com": "Reddit", "www.bbc.com": "BBC News", "bbc.com": "BBC News", "www.theguardian.com": "The Guardian",
    "theguardian.com": "The Guardian", "www.nytimes.com": "The New York Times", "nytimes.com": "The New York Times", "www.washingtonpost.com": "The Washington Post", "www.cnn.com": "CNN", "cnn.com": "CNN",
    "www.npr.org": "NPR", "npr.org": "NPR", "text.npr.org": "NPR", "lite.cnn.com": "CNN Lite", "apnews.com": "Associated Press", "www.reuters.com": "Reuters", "reuters.com": "Reuters",
}


def record_score(links: Column, text: Column, selectors: Column | None = None) -> Column:
    """struct(score, issues) of an extraction with links array(text, href) and rendered text: up to 40 for items, 30
    for links, 20 unless menu entries were caught (50 off for more than three), 10 for enough text. Each issue of the
    selectors (an array of them) takes five points and is listed after the others."""
    brittle = F.flatten(F.transform(selectors, selector_issues)) if selectors is not None else F.array().cast("array<string>")
    n = F.size(links)
    bullets = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike("^[•-]")))
    items = F.when(n > 0, n).otherwise(bullets)
    menu = F.size(F.filter(links, lambda x: F.lower(x["text"]).rlike(f"^({'|'.join(MENU_WORDS)})( |$)")))
    thin = F.octet_length(text) < 100
    score = F.when(items < LEAST_ITEMS, items * 10).otherwise(40) + F.when(n == 0, 0).when(n < LEAST_ITEMS, 20).otherwise(30) + F.when(menu > 3, -50).otherwise(20) + F.when(thin, 0).otherwise(10)
    issues = F.array(F.when(items < LEAST_ITEMS, "few items"), F.when(n == 0, "no links").when(n < LEAST_ITEMS, "few links"), F.when(menu > 3, "menu entries"), F.when(thin, "little text"))
    found = F.when(links.isNull(), F.array(F.lit("no result"))).otherwise(F.filter(issues, lambda x: x.isNotNull()))
    return F.struct((F.when(links.isNull(), 0).otherwise(score) - 5 * F.size(brittle)).cast("int").alias("score"), F.concat(found, brittle).alias("issues"))


def extraction_summary(items: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, summary) of items(key, ord, title, href, metadata): counts, the first five items, how many more there are."""
    cut = lambda c, n: F.when(F.octet_length(c) > n, F.concat(byte_prefix(c, n - 3), F.lit("..."))).otherwise(c)
    w = W.Window.partitionBy(key).orderBy("ord")
    line = F.concat(
        F.col("k").cast("string"), F.lit(". "), cut(F.col("title"), 60),
        F.when(F.col("href") != "", F.concat(F.lit("\n   → "), cut(F.col("href"), 50))).otherwise(""),
        F.when(F.col("metadata") != "", F.concat(F.lit("\n   ["), cut(F.col("metadata"), 60), F.lit("]"))).otherwise(""),
    )
    ranked = items.withColumn("k", F.row_number().over(w))
    rows = ranked.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("href") != "").alias("linked"), F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", line.alias("line"))))).alias("first"))
    head = F.concat(F.lit("Extracted "), F.col("n").cast("string"), F.lit(" items\nItems with links: "), F.col("linked").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("\n\nFirst 5 items:\n"))
    body = F.array_join(F.transform("first", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    more = F.when(F.col("n") > 5, F.concat(F.lit("\n... and "), (F.col("n") - 5).cast("string"), F.lit(" more\n"))).otherwise("")
    return rows.select(key, F.concat(head, body, more).alias("summary"))


def is_link_heavy(domain: Column) -> Column:
    any_ = F.lit(False)
    for d in LINK_HEAVY:
        any_ = any_ | F.contains(domain, F.lit(d))
    return any_ | F.lower(domain).rlike("|".join(NEWS_WORDS))


def is_bad_title(title: Column) -> Column:
    """Too short, a section number, or a menu entry."""
    t = trimmed(title)
    return (F.octet_length(t) < 3) | t.rlike(r"^[12]\.") | F.lower(t).isin(*TITLE_MENU)


def site_title(domain: Column) -> Column:
    """A site's name, else the first part of its domain with a capital."""
    names = F.create_map(*[F.lit(x) for pair in SITE_NAMES.items() for x in pair])
    bare = F.regexp_replace(domain, r"^www\.", "")
    head = F.substring_index(bare, ".", 1)
    plain = F.when(F.contains(bare, F.lit(".")) & (head != ""), F.concat(F.upper(F.left(head, F.lit(1))), F.substring(head, 2, 1000))).otherwise(bare)
    return F.coalesce(F.try_element_at(names, domain), plain)


def _json_part(answer: Column) -> Column:
    return F.regexp_extract(answer, r"(?s)(\{.*\})", 1)


def skip_answer(answer: Column) -> Column:
    """struct(skip, reason) of a rule writer's answer: whether it says that the default reading is better."""
    said = F.from_json(_json_part(answer), "skip boolean, reason string")
    skip = F.coalesce(said["skip"] & F.contains(answer, F.lit('"skip"')), F.lit(False))
    return F.struct(skip.alias("skip"), F.when(skip, F.coalesce(said["reason"], F.lit(""))).otherwise("").alias("reason"))


def rule_answer(answer: Column) -> Column:
    """The rule in an answer, fenced or not: struct(page_type, selectors, template); null if there is none."""
    schema = "page_type string, selectors map<string,string>, template string"
    return F.from_json(F.nullif(_json_part(answer), F.lit("")), schema)


def best_attempt(attempts: DataFrame, key: str = "domain") -> DataFrame:
    """Of attempts(key, attempt, score, ...) the best of each key, at equal scores the earliest."""
    w = W.Window.partitionBy(key).orderBy(F.desc("score"), "attempt")
    return attempts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
