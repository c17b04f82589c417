"""Feeds: RSS 2.0, Atom and RDF by the built-in XML reader, OPML, and stored state."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlake.functions.text import first_non_empty, guid_of, trimmed
from weftlake.functions.values import feed_date

_RSS_ITEM = "struct<title:string,link:string,description:string,encoded:string,author:string,creator:string,guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,date:string>"
RSS = f"channel struct<title:string,link:string,description:string,item:array<{_RSS_ITEM}>>"
_ATOM_LINK = "array<struct<_href:string,_rel:string,_VALUE:string>>"
ATOM = f"title string, subtitle string, link {_ATOM_LINK}, entry array<struct<id:string,title:string,link:{_ATOM_LINK},summary:string,content:struct<_VALUE:string,_type:string>,published:string,updated:string,author:struct<name:string>>>"
RDF = "channel struct<title:string,link:string,description:string>, item array<struct<title:string,link:string,description:string,creator:string,date:string>>"
_OPML = ("url", "title", "site_url", "category")
#: Feeds of OPML texts that a task hands on at once.
ROWS = 2048
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "valueTag": "_VALUE", "attributePrefix": "_"}


@F.arrow_udf(T.StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def clean(c: Column) -> Column:
    """Character references decoded, white space collapsed; texts without an ampersand stay in the JVM."""
    c = F.coalesce(c, F.lit(""))
    return trimmed(F.regexp_replace(F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c), r"[ \n\r\t]+", " "))


def _alternate(links: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate")), F.lit(1))["_href"], F.lit(""))


def parse_feeds(bodies: DataFrame, key: str = "feed_url", body: str = "body") -> DataFrame:
    """(key, type, title, link, description, items): the first of RSS 2.0, Atom and RDF that a body is.

    items is an array of (guid, title, link, description, content, author, published). A body that is none
    of them has a null type and items. A byte order mark is dropped; a missing guid is the hash of the link.
    """
    source = F.regexp_replace(F.col(body), "^﻿", "")
    rows = bodies.select(F.col(key).alias("__key"), source.alias("__body"))
    root = F.regexp_extract("__body", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:[\w-]+:)?(\w+)", 1)
    rows = rows.withColumn("root", root)
    rss = F.when(F.col("root") == "rss", F.from_xml("__body", RSS, _OPTIONS))
    atom = F.when(F.col("root") == "feed", F.from_xml("__body", ATOM, _OPTIONS))
    rdf = F.when(F.col("root") == "RDF", F.from_xml("__body", RDF, _OPTIONS))
    rows = rows.withColumn("rss", rss).withColumn("atom", atom).withColumn("rdf", rdf)

    def item(guid, title, link, description, content, author, published):
        return F.struct(guid.alias("guid"), title.alias("title"), link.alias("link"), description.alias("description"), content.alias("content"), author.alias("author"), published.alias("published"))

    none = F.lit("")
    or_none = lambda c: F.coalesce(c, none)
    rss_items = F.transform("rss.channel.item", lambda x: item(F.coalesce(F.nullif(trimmed(x["guid"]["_VALUE"]), none), guid_of(or_none(x["link"]))), x["title"], or_none(x["link"]), x["description"], or_none(x["encoded"]), first_non_empty(x["author"], x["creator"]), feed_date(F.coalesce(x["pubDate"], x["date"]))))
    atom_items = F.transform("atom.entry", lambda x: item(F.coalesce(F.nullif(x["id"], none), guid_of(_alternate(x["link"]))), x["title"], _alternate(x["link"]), x["summary"], or_none(x["content"]["_VALUE"]), or_none(x["author"]["name"]), feed_date(F.coalesce(F.nullif(x["published"], none), x["updated"]))))
    rdf_items = F.transform("rdf.item", lambda x: item(guid_of(or_none(x["link"])), x["title"], or_none(x["link"]), x["description"], none, or_none(x["creator"]), feed_date(x["date"])))
    filled = lambda title, items: (or_none(title) != "") | (F.coalesce(F.size(items), F.lit(0)) > 0)
    is_rss, is_atom, is_rdf = filled(F.col("rss.channel.title"), F.col("rss.channel.item")), filled(F.col("atom.title"), F.col("atom.entry")), filled(F.col("rdf.channel.title"), F.col("rdf.item"))
    kind = F.when(F.col("rss").isNotNull() & is_rss, "rss").when(F.col("atom").isNotNull() & is_atom, "atom").when(F.col("rdf").isNotNull() & is_rdf, "rdf")
    rows = rows.withColumn("kind", kind)
    pick = lambda a, b, c: F.when(F.col("kind") == "rss", a).when(F.col("kind") == "atom", b).when(F.col("kind") == "rdf", c)
    return rows.select(
        F.col("__key").alias(key),
        F.when(F.col("kind") == "rdf", "rss").otherwise(F.col("kind")).alias("type"),
        pick(F.col("rss.channel.title"), F.col("atom.title"), F.col("rdf.channel.title")).alias("title"),
        pick(or_none(F.col("rss.channel.link")), _alternate(F.col("atom.link")), or_none(F.col("rdf.channel.link"))).alias("link"),
        pick(or_none(F.col("rss.channel.description")), or_none(F.col("atom.subtitle")), or_none(F.col("rdf.channel.description"))).alias("description"),
        pick(rss_items, atom_items, rdf_items).alias("items"),
    )


def feed_items(parsed: DataFrame, key: str = "feed_url") -> DataFrame:
    """(key, ord, guid, title, link, description, content, author, published), texts cleaned."""
    # a plain posexplode gets a filter on the size of its array put below the parse, which parses each body anew for every mention of it; the outer one gets none
    rows = parsed.select(key, F.posexplode_outer("items").alias("ord", "i")).where("ord is not null").select(key, "ord", "i.*")
    return rows.select(key, "ord", "guid", clean(F.col("title")).alias("title"), "link", clean(F.col("description")).alias("description"), "content", clean(F.col("author")).alias("author"), "published")


def read_opml(source: str | bytes) -> list[dict]:
    """Feeds of an OPML text: url, title, site_url and category, the path of outlines around it joined by '/'. Raises ValueError."""
    try:
        root = ET.fromstring(source)
    except ET.ParseError as e:
        raise ValueError(str(e)) from e
    out: list[dict] = []

    def walk(node, path: str) -> None:
        for o in node.findall("outline"):
            name = o.get("title") or o.get("text") or ""
            if o.get("xmlUrl"):
                out.append({"url": o.get("xmlUrl"), "title": name, "site_url": o.get("htmlUrl") or "", "category": path})
            inner = o.get("text") or o.get("title") or ""
            if len(o):
                walk(o, f"{path}/{inner}" if path and inner else path or inner)

    body = root.find("body")
    if body is not None:
        walk(body, "")
    return out


def opml_feeds(bodies: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, ord, url, title, site_url, category) of OPML texts; unreadable ones give no row.

    One text at a time is read, and its feeds are handed on in batches of at most ROWS, so a task holds no more than a text and its feeds. Lowers the session's bound on the bytes of an Arrow batch.
    """
    from weftlake.sources.state import bounded_batches

    kept = bodies.select(key, F.col(body).cast("string"))
    bounded_batches(bodies.sparkSession)
    schema = T.StructType([kept.schema[0], T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in _OPML]])

    def run(batches):
        for batch in batches:
            at, ords, found = [], [], []

            def out(batch=batch):
                columns = [pa.array([f[c] for f in found], pa.string()) for c in _OPML]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(ords, pa.int32()), *columns], names=schema.names)

            for k, text in enumerate(batch.column(1)):
                try:
                    feeds = read_opml(text.as_py() or "")
                except ValueError:
                    continue
                for first in range(0, len(feeds), ROWS):
                    part = feeds[first : first + ROWS]
                    if len(found) + len(part) > ROWS:
                        yield out()
                        at, ords, found = [], [], []
                    at += [k] * len(part)
                    ords += range(first, first + len(part))
                    found += part
            if found:
                yield out()

    return kept.mapInArrow(run, schema)


def opml_groups(feeds: DataFrame) -> DataFrame:
    """(category, feeds): feeds of each category in order of title and url."""
    return feeds.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("title", "url", "site_url"))).alias("feeds"))


def write_opml(feeds: DataFrame, title: str, created: str = "") -> str:
    """The feeds as one OPML text, uncategorised ones first, categories in order. Subscriptions are one user's, so they fit the driver."""
    outline = lambda f, pad: f"{pad}<outline type=\"rss\" text={quoteattr(f.title)} title={quoteattr(f.title)} xmlUrl={quoteattr(f.url)}" + (f" htmlUrl={quoteattr(f.site_url)}" if f.site_url else "") + "/>"
    rows = []
    for r in opml_groups(feeds).orderBy("category").collect():
        pad = "    " if not r.category else "      "
        if r.category:
            rows.append(f"    <outline text={quoteattr(r.category)} title={quoteattr(r.category)}>")
        rows += [outline(f, pad) for f in r.feeds]
        if r.category:
            rows.append("    </outline>")
    head = f"    <title>{html.escape(title)}</title>" + (f"\n    <dateCreated>{created}</dateCreated>" if created else "")
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<opml version="2.0">', "  <head>", head, "  </head>", "  <body>", *rows, "  </body>", "</opml>"]) + "\n"


FEED = "url string, title string, description string, site_url string, category string, last_fetch timestamp, fetch_error string"
ITEM = "guid string, feed_url string, title string, link string, description string, content string, author string, published timestamp"
READ = "guid string, read_at timestamp"
_SAFE = re.compile(r"[^A-Za-z0-9_.-]")
