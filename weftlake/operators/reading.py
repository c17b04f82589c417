"""A page read from end to end: the site's own parser, else the rule of its host where that is good enough, else the default reading."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftlake.functions.dom import Node, parse
from weftlake.functions.urls import normal_host
from weftlake.operators import search
from weftlake.operators.content import content_nodes, content_root
from weftlake.operators.rules import apply_list_rule, beats_default

#: Fields of a list rule, besides the domain it is for.
RULE_FIELDS = ["root", "articles", "title", "metadata", "layout"]
_ENTRIES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("href", T.StringType())]))


def _discussion(nodes: list[Node]) -> list[dict]:
    stories = [{"kind": "story", "text": s["title"], "href": s["href"]} for s in search.discussion_stories(nodes)]
    return stories or [{"kind": "comment", "text": c["text"], "href": ""} for c in search.discussion_comments(nodes) if not c["deleted"]]


#: Parsers of sites that have one, by host.
SITES = {"news.ycombinator.com": _discussion}


def hosts_of(pages: DataFrame) -> DataFrame:
    """(host) of all pages, each once."""
    return pages.select(normal_host(F.col("url")).alias("host")).where("host <> ''").distinct()


def _quality(items: Column) -> dict[str, Column]:
    """What decides whether items are good enough, from an array of (kind, text, href)."""
    share = lambda test: F.size(F.filter(items, test)) / F.size(items)
    size = F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["text"])) / F.size(items)
    good = lambda x: F.octet_length(x["text"]).between(10, 500) & (F.length(F.regexp_replace(x["text"], r"[0-9.]", "")) > 5)
    return {"items": F.size(items), "avg_title_bytes": size, "good_ratio": share(good), "link_ratio": share(lambda x: x["href"] != "")}


def read_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, reader, entries) of every row of pages(page_id, url, html).

    rules(domain, root, articles, title, ..., layout) has one list rule for a host at most; pages meet them by a join on the host. reader is `site` where the host
    has a parser of its own that finds something, `rule` where the rule's items beat the default (count, title length, good titles, links in list layouts), `default` else and `none` where
    the page cannot be parsed. entries are (kind, text, href) of what the reader gives. Each page is parsed once, and only the reading that wins stays.
    """
    fields = [F.col(c) if c in rules.columns else F.lit("").alias(c) for c in RULE_FIELDS]
    own = rules.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain"), *fields)
    rows = pages.select("page_id", normal_host(F.col("url")).alias("host"), "html").join(own, F.col("host") == F.col("domain"), "left")
    schema = T.StructType([rows.schema["page_id"], T.StructField("host", T.StringType()), T.StructField("layout", T.StringType()), *[T.StructField(c, _ENTRIES) for c in ("site", "ruled", "plain")]])

    def read(batches):
        kind = to_arrow_type(_ENTRIES)
        for batch in batches:
            out: list[list] = [[], [], []]
            for r in batch.select(["host", "html", "domain", *RULE_FIELDS]).to_pylist():
                try:
                    nodes = parse(r["html"])
                except ValueError:
                    nodes = None
                site = SITES[r["host"]](nodes) if nodes is not None and r["host"] in SITES else []
                ruled = apply_list_rule(nodes, {k: v for k, v in r.items() if v}) if nodes is not None and r["domain"] and (r["articles"] or r["title"]) else []
                root = content_root(nodes) if nodes is not None else None
                plain = [{"kind": x["type"], "text": x["text"], "href": x["href"]} for x in content_nodes(nodes, root)] if root is not None else []
                for column, found in zip(out, (site, [{"kind": "item", "text": x["title"], "href": x["href"]} for x in ruled], None if nodes is None else plain), strict=True):
                    column.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("layout"), *[pa.array(c, kind) for c in out]], schema.names)

    made = rows.mapInArrow(read, schema)
    for name, value in _quality(F.col("ruled")).items():
        made = made.withColumn(name, F.when(F.size("ruled") > 0, value))
    reader = F.when(F.size("site") > 0, "site").when(F.coalesce(beats_default(made, F.coalesce("layout", F.lit(""))), F.lit(False)), "rule").when(F.col("plain").isNull(), "none").otherwise("default")
    made = made.withColumn("reader", reader)
    return made.select("page_id", "host", "reader", F.when(F.col("reader") == "site", F.col("site")).when(F.col("reader") == "rule", F.col("ruled")).otherwise(F.coalesce("plain", F.array().cast(_ENTRIES))).alias("entries"))
