"""The inspector's view of pages: one row per element, default visibility, suggestions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions.dom import Node, first, text_of
from weftlake.operators.content import page_parts

#: Fixed values.
SKIPPED = frozenset("script style noscript template link meta svg path br hr".split())
HIDDEN_TAGS = frozenset("nav header footer aside".split())
HIDDEN_WORDS = re.compile("ad|sidebar|nav|menu|footer|header|social|share|comment")
_TYPE = "array<struct<ord:int,parent:int,post:int,depth:int,tag:string,id:string,classes:array<string>,text:string,visible:boolean,selector:string,shown:boolean>>"


def inspector_nodes(nodes: list[Node]) -> list[dict]:
    """Every element under the body but skipped ones, in document order. parent and post refer to ord; an element is shown if it and all around it are visible."""
    body = first(nodes, lambda n: n.tag == "body")
    if body is None:
        return []
    out: list[dict] = []

    def walk(i: int, parent: int, depth: int, path: str, around: bool) -> None:
        n = nodes[i]
        classes = n.classes()
        name = n.tag + (f"#{n.attrs['id']}" if n.attrs.get("id") else f".{classes[0]}" if classes else "")
        selector = f"{path} > {name}" if path else name
        at = len(out)
        visible = n.tag not in HIDDEN_TAGS and not any(HIDDEN_WORDS.search(c.lower()) for c in classes)
        out.append({"ord": at, "parent": parent, "post": 0, "depth": depth, "tag": n.tag, "id": n.attrs.get("id", ""), "classes": classes, "text": text_of(nodes, i), "visible": visible, "selector": selector, "shown": around and visible})
        j = i + 1
        while j < n.end:
            if nodes[j].tag[0] != "#" and nodes[j].tag not in SKIPPED:
                walk(j, at, depth + 1, selector, around and visible)
            j = nodes[j].end
        out[at]["post"] = len(out)

    walk(body, -1, 0, "", True)
    return out


def inspect(pages: DataFrame) -> DataFrame:
    """(page_id, ord, parent, post, depth, tag, id, classes, text, visible, selector, shown).

    shown: the element and all around it are visible; each page is walked once.
    """
    rows = page_parts(pages, ["elements"], more={"elements": (inspector_nodes, _TYPE)})
    return rows.select("page_id", F.inline("elements"))


def visible_blocks(elements: DataFrame) -> DataFrame:
    """Shown elements without a block inside: (page_id, ord, tag, selector, text)."""
    inner = elements.where(F.col("tag").isin("p", "div", "section", "article", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")).select("page_id", F.col("parent").alias("ord")).distinct()
    return elements.where("shown and text <> ''").join(inner, ["page_id", "ord"], "left_anti").select("page_id", "ord", "tag", "selector", "text")


def suggestions(elements: DataFrame, least: int = 100, top: int = 10) -> DataFrame:
    """(page_id, rank, ord, selector, bytes): per page the hidden elements with most text, navigation left out."""
    size = F.octet_length("text")
    w = W.Window.partitionBy("page_id").orderBy(F.desc("bytes"), "ord")
    rows = elements.where(~F.col("visible") & ~F.col("tag").isin("nav", "header", "footer")).select("page_id", "ord", "selector", size.alias("bytes")).where(F.col("bytes") >= least)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
