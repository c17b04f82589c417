"""Content as text and text as content: page printing, template output, plain text to HTML."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlake.functions import layout
from weftlake.functions.text import escape
from weftlake.operators.content import PARTS, page_parts

_BULLET = re.compile(r"^\s*(?:[•\-*→]|\d+\.)\s+")
_MARK = re.compile(r"\*\*(.+?)\*\*|~~(.+?)~~|\[([^\]]+)\]\(([^)]+)\)")


def render_content(content: list[dict], width: int = 80, title: str = "") -> str:
    """Content nodes as plain lines of at most width columns."""
    under: dict[int, list[dict]] = {}
    for c in content:
        under.setdefault(c["parent"], []).append(c)
    out: list[str] = [title, "", ""] if title else [""]

    def text_block(s: str, lead: str = "", rest: str | None = None) -> None:
        rest = lead if rest is None else rest
        for k, row in enumerate(layout.wrap(s, max(width - len(lead), 10))):
            out.append((rest if k else lead) + row)

    def walk(parent: int, depth: int = 0) -> None:
        for c in under.get(parent, []):
            kind, text = c["type"], c["text"]
            if kind == "heading1":
                out.extend(["", layout.align(text.upper(), width, "center").rstrip(), ""])
            elif kind in ("heading2", "heading3"):
                out.extend(["", text, ""])
            elif kind in ("paragraph", "block_link"):
                text_block(text)
                out.append("")
            elif kind == "blockquote":
                text_block(text, "  │ ")
                out.append("")
            elif kind == "list":
                walk(c["ord"], depth + 1)
                out.append("")
            elif kind == "list_item":
                text_block(text, "  " * max(depth - 1, 0) + "• ", "  " * max(depth, 1))
            elif kind == "code_block":
                out.extend(["    " + row for row in text.split("\n")])
                out.append("")
            elif kind == "table":
                rows = [[x["text"] for x in under.get(r["ord"], [])] for r in under.get(c["ord"], [])]
                out.extend(layout.draw_table(rows, width).split("\n"))
                out.append("")
            elif kind == "hr":
                out.extend(["─" * width, ""])
            elif kind in ("text", "link", "strong", "emphasis"):
                text_block(text)
            elif kind == "form":
                walk(c["ord"], depth)
            elif kind == "input":
                out.append(f"[{text}]")

    walk(-1)
    return layout.plain("\n".join(out))


def printed(pages: DataFrame, width: int = 80) -> DataFrame:
    """(page_id, text): every page as plain text."""

    def one(nodes):
        return render_content(PARTS["content"][0](nodes), width, PARTS["title"][0](nodes))

    return page_parts(pages, ["text"], more={"text": (one, "string")}).select("page_id", "text")


def template_nodes(text: str, links: list[dict]) -> list[dict]:
    """Rendered template text as content nodes. A list item takes the address of the link with its text, else of the longest link text within it."""
    by_text = {x["text"]: x["href"] for x in links}
    longest = sorted(by_text, key=lambda t: (-len(t), t))
    out: list[dict] = []
    current = -1

    def add(kind: str, parent: int, s: str, href: str = "") -> int:
        out.append({"ord": len(out), "parent": parent, "type": kind, "text": s, "href": href})
        return len(out) - 1

    def marked(parent: int, s: str) -> None:
        at = 0
        for m in _MARK.finditer(s):
            if m.start() > at:
                add("text", parent, s[at : m.start()])
            if m[1]:
                add("strong", parent, m[1])
            elif m[2]:
                add("dim", parent, m[2])
            else:
                add("link", parent, m[3], m[4])
            at = m.end()
        if at < len(s):
            add("text", parent, s[at:])

    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            current = -1
            continue
        if bare[0] in "═─━-=" and len(bare.encode()) >= 3 and bare.count(bare[0]) > 0.8 * len(bare):
            add("hr", -1, "")
            current = -1
        elif m := _BULLET.match(line):
            if current < 0:
                current = add("list", -1, "")
            item = line[m.end() :].strip()
            plain = _MARK.sub(lambda x: x[1] or x[2] or x[3], item)
            href = by_text.get(plain) or next((by_text[t] for t in longest if t and t in plain), "")
            marked(add("list_item", current, plain, href), item)
        else:
            current = -1
            marked(add("paragraph", -1, _MARK.sub(lambda x: x[1] or x[2] or x[3], bare)), bare)
    return out


def record_documents(records: DataFrame) -> DataFrame:
    """Content nodes (page_id, ord, parent, type, text, href) of records(page_id, text, links) with rendered templates."""
    node = T._parse_datatype_string("array<struct<ord:int,parent:int,type:string,text:string,href:string>>")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            nodes = [template_nodes(t or "", x or []) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, to_arrow_type(node))], ["page_id", "nodes"])

    kind = records.schema["page_id"].dataType
    rows = records.select("page_id", "text", "links").mapInArrow(run, T.StructType([T.StructField("page_id", kind), T.StructField("nodes", node)]))
    return rows.select("page_id", F.inline("nodes"))


def text_to_html(text: Column) -> Column:
    """Paragraphs between blank lines, line breaks within."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    safe = lambda p: F.replace(F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br>"))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), safe(p), F.lit("</p>\n"))), "")


def dictionary_pages(entries: DataFrame) -> DataFrame:
    """(word, html) of dictionary rows, meanings and definitions in order."""
    item = F.concat(F.lit("<li>"), escape(F.col("definition")), F.when(F.col("example") != "", F.concat(F.lit("<br><em>"), escape(F.col("example")), F.lit("</em>"))).otherwise(""), F.lit("</li>"))
    meanings = entries.groupBy("word", "phonetic", "meaning_ord", "part_of_speech").agg(F.sort_array(F.collect_list(F.struct("definition_ord", item.alias("item")))).alias("items"))
    part = F.concat(F.lit("<h2>"), escape(F.col("part_of_speech")), F.lit("</h2><ol>"), F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("</ol>"))
    words = meanings.groupBy("word").agg(F.max("phonetic").alias("phonetic"), F.sort_array(F.collect_list(F.struct("meaning_ord", part.alias("part")))).alias("parts"))
    return words.select("word", F.concat(F.lit("<h1>"), escape(F.col("word")), F.lit("</h1>"), F.when(F.col("phonetic") != "", F.concat(F.lit("<p>"), escape(F.col("phonetic")), F.lit("</p>"))).otherwise(""), F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("html"))
