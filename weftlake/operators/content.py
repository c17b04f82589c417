"""Pages to content: roots, navigation, headings, lists, tables, articles and links.

Each page is parsed once, in one Arrow pass, into the parts that are asked for; what follows is
ordinary DataFrame work on typed columns. Byte counts are of UTF-8, as the thresholds are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlake.functions.dom import HEADINGS, Node, ancestors, children, first, parse, text_of

#: Classes that mark an article's body, navigation elements, and words of advertising classes.
INDICATORS = ["article-content", "article-body", "post-content", "entry-content", "story-body", "main-content", "page-content", "content-body"]
NAVIGATION = {"nav": "Navigation", "header": "Header", "footer": "Footer", "aside": "Sidebar", "menu": "Menu"}
ADS = re.compile("sponsored|ad-|promo|advertisement")
SKIPPED = frozenset("script style noscript template".split())
_CONTAINERS = frozenset({"div", "section", "main", "article", "td", "body"})
_MAIN_IDS = ("content", "main-content", "main")
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json")
RICHNESS_DEPTH, CARD_DEPTH, COUNT_DEPTH = 10, 6, 5
#: What a task holds of finished pages before it hands them on, about in bytes: their text, and so much for each row and each item made.
HELD, HELD_ROW, HELD_ITEM = 4 << 20, 64, 512


def nbytes(s: str) -> int:
    return len(s.encode("utf-8", "replace"))


def is_ad(n: Node) -> bool:
    return "class" in n.attrs and bool(ADS.search(n.attrs["class"].lower()))


def in_ad(nodes: list[Node], i: int) -> bool:
    return is_ad(nodes[i]) or any(is_ad(nodes[j]) for j in ancestors(nodes, i))


def elements(nodes: list[Node], i: int, *tags: str):
    """Indices under i, in document order, of elements with one of the tags."""
    for j in range(i + 1, nodes[i].end if nodes else 0):
        if nodes[j].tag in tags:
            yield j


def richness(nodes: list[Node], i: int) -> int:
    """2 for a paragraph, 3 for a main heading, 5 for an article, 5 off for navigation, to a bounded depth."""
    score = 0
    for j in range(i + 1, nodes[i].end):
        n = nodes[j]
        if n.depth - nodes[i].depth <= RICHNESS_DEPTH:
            score += {"p": 2, "h1": 3, "h2": 3, "h3": 3, "article": 5, "nav": -5, "header": -5, "footer": -5, "aside": -5}.get(n.tag, 0)
    return score


def content_root(nodes: list[Node]) -> int | None:
    """Where the content is: the main element (or an article or marked part in it), else an article, else by role or id, else the richest part, else the body."""
    body = first(nodes, lambda n: n.tag == "body")
    if body is None:
        return None
    marked = lambda n: any(c in n.attrs.get("class", "") for c in INDICATORS)
    find = lambda test, at=body: first(nodes, test, at + 1, nodes[at].end)
    main = next(elements(nodes, body, "main"), None)
    if main is not None:
        hit = find(lambda n: n.tag == "article" and marked(n), main)
        if hit is not None:
            return hit
        articles = list(elements(nodes, main, "article"))
        if len(articles) >= 2:
            return main
        hit = find(lambda n: n.tag in ("div", "section") and marked(n), main)
        return hit if hit is not None else articles[0] if articles else main
    named: dict[str, int] = {}  # the first of each kind, from one look at all nodes
    for j in range(body + 1, nodes[body].end):
        n = nodes[j]
        if n.tag == "article":
            return j
        if n.attrs and n.tag[0] != "#":
            if n.attrs.get("role") == "main":
                named.setdefault("role", j)
            if n.tag in _CONTAINERS and (ident := n.attrs.get("id")) in _MAIN_IDS:
                named.setdefault(ident, j)
    for kind in ("role", *_MAIN_IDS):
        if kind in named:
            return named[kind]
    best, most = None, 2
    for j in elements(nodes, body, "div", "section"):
        score = richness(nodes, j)
        if score > most:
            best, most = j, score
    return body if best is None else best


def page_language(nodes: list[Node]) -> str:
    i = first(nodes, lambda n: n.tag == "html")
    return "" if i is None else nodes[i].attrs.get("lang", "").split("-")[0].lower()


def page_title(nodes: list[Node]) -> str:
    i = first(nodes, lambda n: n.tag == "title")
    return "" if i is None else text_of(nodes, i)


def theme_candidates(nodes: list[Node]) -> list[str]:
    """Tile colour, body background and theme colour, as they stand."""
    meta = {n.attrs.get("name", "").lower(): n.attrs.get("content", "") for n in reversed(nodes) if n.tag == "meta"}
    body = first(nodes, lambda n: n.tag == "body")
    return [meta.get("msapplication-tilecolor", ""), "" if body is None else nodes[body].attrs.get("bgcolor", ""), meta.get("theme-color", "")]


def feed_links(nodes: list[Node]) -> list[dict]:
    return [
        {"url": n.attrs["href"], "title": n.attrs.get("title", ""), "type": n.attrs["type"].lower()}
        for n in nodes
        if n.tag == "link" and n.attrs.get("rel", "").lower() == "alternate" and n.attrs.get("type", "").lower() in FEED_TYPES and n.attrs.get("href")
    ]


def anchors(nodes: list[Node], i: int = 0) -> list[dict]:
    """Anchors with their text, in document order."""
    return [{"ord": k, "text": text_of(nodes, j), "href": nodes[j].attrs.get("href", ""), "is_image": any(nodes[m].tag == "img" for m in range(j, nodes[j].end))} for k, j in enumerate(elements(nodes, i, "a"))]


def navigation(nodes: list[Node]) -> list[dict]:
    """Outermost navigation parts that hold links."""
    out, i = [], first(nodes, lambda n: n.tag == "body") or 0
    while i < len(nodes):
        n = nodes[i]
        if n.tag in NAVIGATION:
            links = [{"text": a["text"], "href": a["href"]} for a in anchors(nodes, i) if a["text"] and a["href"]]
            if links:
                out.append({"label": n.attrs.get("aria-label") or NAVIGATION[n.tag], "links": links})
            i = n.end
        else:
            i += 1
    return out


def heading_text(nodes: list[Node], i: int) -> str:
    """Text of a heading's children, a part equal to the one before left out."""
    parts: list[str] = []
    for j in children(nodes, i):
        t = re.sub(r"\s+", " ", nodes[j].text).strip() if nodes[j].tag == "#text" else text_of(nodes, j) if nodes[j].tag[0] != "#" else ""
        if t and (not parts or parts[-1] != t):
            parts.append(t)
    return " ".join(parts)


def file_label(url: str) -> str:
    last = re.split(r"[?#]", url)[0].rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[0] if "." in last[1:] else last


def image_label(n: Node) -> str:
    return f"[Image: {n.attrs.get('alt') or file_label(n.attrs.get('src', '')) or 'image'}]"


def cut_at_word(s: str, n: int) -> str:
    if nbytes(s) <= n:
        return s
    cut = s.encode()[:n].decode("utf-8", "ignore")
    space = cut.rfind(" ")
    return (cut[:space] if space >= 0 and nbytes(cut[:space]) > n // 2 else cut) + "..."


def table_kind(nodes: list[Node], i: int) -> str:
    """navigation, stories, data or layout."""
    if nodes[i].attrs.get("role") == "navigation":
        return "navigation"
    if any("athing" in nodes[r].attrs.get("class", "") for r in elements(nodes, i, "tr")):
        return "stories"
    rows = [r for r in elements(nodes, i, "tr") if next(j for j in ancestors(nodes, r) if nodes[j].tag == "table") == i]
    if any(nodes[c].tag == "th" for r in rows for c in children(nodes, r)):
        return "data"
    counts: dict[int, int] = {}
    for r in rows:
        cells = sum(nodes[c].tag in ("td", "th") for c in children(nodes, r))
        counts[cells] = counts.get(cells, 0) + 1
    return "data" if any(c >= 2 and n >= 2 for c, n in counts.items()) else "layout"


def table_cells(nodes: list[Node], i: int = 0) -> list[dict]:
    """Cells of data tables; a link that is at least half of a cell's text gives the cell its address."""
    out = []
    for k, t in enumerate([t for t in elements(nodes, i, "table") if table_kind(nodes, t) == "data"]):
        out += [{"table_ord": k, **c} for c in _cells_of(nodes, t)]
    return out


_DATED = re.compile(r"^\d{4}-\d{2}-\d{2}")
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def iso_day(s: str) -> str:
    if _DATED.match(s) and 1 <= int(s[5:7]) <= 12:
        return f"{_MONTHS[int(s[5:7]) - 1]} {s[8:10].removeprefix('0')}, {s[:4]}"
    return s


def article(nodes: list[Node], i: int) -> dict:
    """Title and link, description, author and date of an article element."""
    title = href = ""
    for h in elements(nodes, i, "h1", "h2", "h3"):
        title = heading_text(nodes, h)
        inner = next(elements(nodes, h, "a"), None)
        outer = next((j for j in ancestors(nodes, h) if nodes[j].tag == "a" and j >= i), None)
        link = inner if inner is not None else outer
        href = nodes[link].attrs.get("href", "") if link is not None else ""
        if title:
            break
    if not title:
        for a in elements(nodes, i, "a"):
            if nbytes(text_of(nodes, a)) > 10:
                title, href = text_of(nodes, a), nodes[a].attrs.get("href", "")
                break
    description = next((t for t in (text_of(nodes, p) for p in elements(nodes, i, "p")) if nbytes(t) > 50 and not t.startswith("By ")), "")
    author = date = ""
    for j in range(i + 1, nodes[i].end):
        n = nodes[j]
        named = n.attrs.get("class", "").lower()
        if not author and n.tag[0] != "#" and ("author" in named or "byline" in named or n.attrs.get("rel") == "author"):
            author = re.sub(r"^[Bb]y\s+", "", text_of(nodes, j))
        if not date and n.tag == "time":
            date = iso_day(n.attrs.get("datetime", "")) or text_of(nodes, j)
    return {"title": title, "href": href, "description": cut_at_word(description, 200), "author": author, "date": date, "source": re.sub(r"^www\.", "", re.sub(r"^https?://", "", href).split("/")[0]) if href.startswith("http") else ""}


_NUMBERED = re.compile(r"^[0-9]+\. ")


def story_cards(nodes: list[Node], i: int, depth: int = CARD_DEPTH) -> list[dict]:
    """Headings of the second and third level with a link of over ten bytes, outside of advertising."""
    out, j = [], i + 1
    while j < nodes[i].end:
        n = nodes[j]
        if n.tag[0] != "#" and is_ad(n) or n.tag in NAVIGATION:
            j = n.end
            continue
        if n.tag in ("h2", "h3") and n.depth - nodes[i].depth <= depth:
            a = next(elements(nodes, j, "a"), None)
            if a is not None and nbytes(text_of(nodes, a)) > 10 and not _NUMBERED.match(text_of(nodes, a)):
                card = {"title": text_of(nodes, a), "href": nodes[a].attrs.get("href", ""), "description": "", "author": "", "date": "", "source": ""}
                for s in children(nodes, n.parent):
                    if s <= j:
                        continue
                    if nodes[s].tag in HEADINGS:
                        break
                    t = text_of(nodes, s) if nodes[s].tag in ("p", "div", "span") else ""
                    if nodes[s].tag == "p" and nbytes(t) > 30 or nodes[s].tag in ("div", "span") and 50 < nbytes(t) < 300:
                        card["description"] = cut_at_word(t, 200)
                        break
                near = n.parent
                for m in range(near + 1, nodes[near].end):
                    if nodes[m].tag == "time" and nodes[m].depth - nodes[near].depth <= 3 and not card["date"]:
                        card["date"] = iso_day(nodes[m].attrs.get("datetime", "")) or text_of(nodes, m)
                    if "author" in nodes[m].attrs.get("class", "").lower() and nodes[m].depth - nodes[near].depth <= 3 and not card["author"]:
                        card["author"] = re.sub(r"^[Bb]y\s+", "", text_of(nodes, m))
                out.append(card)
                j = n.end
                continue
        j += 1
    return out


def is_article_list(nodes: list[Node], i: int) -> bool:
    own = [c for c in children(nodes, i) if nodes[c].tag == "article" and not in_ad(nodes, c)]
    return len(own) >= 3 or len(story_cards(nodes, i, COUNT_DEPTH)) >= 3


def articles(nodes: list[Node], root: int | None) -> list[dict]:
    """Articles of a list page: its story cards, or with fewer than three of those its direct articles."""
    if root is None or not is_article_list(nodes, root):
        return []
    cards = story_cards(nodes, root)
    if len(cards) < 3:
        cards = [a for a in (article(nodes, c) for c in children(nodes, root) if nodes[c].tag == "article" and not in_ad(nodes, c)) if a["title"]]
    return [{"ord": k, **c} for k, c in enumerate(cards)]


def story_text(story: dict) -> str:
    """Text of a story's list item: title and source, then the description and then author and date on lines of their own."""
    byline = " · ".join(x for x in (story["author"], story["date"]) if x)
    return story["title"] + (f" ({story['source']})" if story["source"] else "") + "".join(f"\n  {x}" for x in (story["description"], byline) if x)


def block_link(nodes: list[Node], a: int) -> dict:
    """A link around a whole card: title, description and up to three further texts."""
    heading = next(elements(nodes, a, *sorted(HEADINGS)), None)
    paragraphs = [text_of(nodes, p) for p in elements(nodes, a, "p")]
    title = text_of(nodes, heading) if heading is not None else next((t for t in paragraphs if nbytes(t) > 20), "")
    description = next((t for t in paragraphs if nbytes(t) > 20 and t != title), "")
    extra = [text_of(nodes, s) for s in elements(nodes, a, "span", "time", "div") if not any(nodes[c].tag in ("div", "p", *HEADINGS) for c in range(s + 1, nodes[s].end))]
    extra = list(dict.fromkeys(t for t in extra if 3 <= nbytes(t) <= 99 and t not in (title, description)))[:3]
    return {"title": title, "href": nodes[a].attrs.get("href", ""), "description": cut_at_word(description, 120), "extra": extra}


_INLINE = {"a": "link", "strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "mark": "mark", "ins": "insert", "code": "code"}
_LEVELS = {"h1": "heading1", "h2": "heading2", "h3": "heading3", "h4": "heading3", "h5": "heading3", "h6": "heading3"}


def content_nodes(nodes: list[Node], root: int | None) -> list[dict]:
    """The content as a flat tree: ord, parent, type, text, href, id, is_header."""
    out: list[dict] = []
    if root is None:
        return out

    def add(kind: str, parent: int, text: str = "", href: str = "", ident: str = "", header: bool = False) -> int:
        out.append({"ord": len(out), "parent": parent, "type": kind, "text": text, "href": href, "id": ident, "is_header": header})
        return len(out) - 1

    def inline(i: int, parent: int) -> None:
        for j in children(nodes, i):
            n = nodes[j]
            if n.tag == "#text":
                t = re.sub(r"\s+", " ", n.text)
                if t:
                    add("text", parent, t)
            elif n.tag in _INLINE:
                add(_INLINE[n.tag], parent, text_of(nodes, j), n.attrs.get("href", "") if n.tag == "a" else "")
            elif n.tag == "img":
                add("link", parent, image_label(n), n.attrs.get("src", ""))
            elif n.tag == "br":
                add("text", parent, "\n")
            elif n.tag in ("ul", "ol"):
                listed(j, parent)
            elif n.tag[0] != "#" and n.tag not in SKIPPED:
                inline(j, parent)

    def listed(i: int, parent: int) -> None:
        k = add("list", parent)
        for j in children(nodes, i):
            if nodes[j].tag != "li":
                continue
            own = next((a for a in elements(nodes, j, "article") if nodes[a].depth - nodes[j].depth <= 2), None)
            if own is not None:
                d = article(nodes, own)
                add("list_item", k, story_text(d), d["href"])
                continue
            item = add("list_item", k, text_of(nodes, j))
            inline(j, item)

    def walk(i: int, parent: int) -> None:
        for j in children(nodes, i):
            n = nodes[j]
            tag = n.tag
            if tag == "#text":
                t = re.sub(r"\s+", " ", n.text).strip()
                if nbytes(t) > 1:
                    add("text", parent, t)
            elif tag[0] == "#" or tag in SKIPPED or tag in NAVIGATION:
                continue
            elif tag in _LEVELS:
                link = next(elements(nodes, j, "a"), None)
                add(_LEVELS[tag], parent, heading_text(nodes, j), nodes[link].attrs.get("href", "") if link is not None else "", n.attrs.get("id", ""))
            elif tag == "p":
                inline(j, add("paragraph", parent, text_of(nodes, j), "", n.attrs.get("id", "")))
            elif tag == "blockquote":
                walk(j, add("blockquote", parent, text_of(nodes, j)))
            elif tag in ("ul", "ol"):
                listed(j, parent)
            elif tag == "pre":
                add("code_block", parent, "".join(nodes[m].text for m in range(j, n.end) if nodes[m].tag == "#text"))
            elif tag == "details":
                summary = next(elements(nodes, j, "summary"), None)
                if summary is not None:
                    add("heading3", parent, text_of(nodes, summary))
                for c in children(nodes, j):
                    if nodes[c].tag not in ("summary", "pre", "#text"):
                        walk(c, parent) if nodes[c].tag not in ("p", "ul", "ol") else (inline(c, add("paragraph", parent, text_of(nodes, c))) if nodes[c].tag == "p" else listed(c, parent))
            elif tag == "img":
                add("link", parent, image_label(n), n.attrs.get("src", ""))
            elif tag == "hr":
                add("hr", parent)
            elif tag == "table":
                kind = table_kind(nodes, j)
                if kind == "data":
                    t = add("table", parent)
                    row, last = -1, -1
                    for c in _cells_of(nodes, j):
                        if c["row"] != last:
                            row, last = add("table_row", t), c["row"]
                        add("table_cell", row, c["text"], c["href"], "", c["is_header"])
                elif kind == "stories":
                    for d in story_rows(nodes, j):
                        add("link", add("paragraph", parent, f"{d['title']} ({d['figures']})" if d["figures"] else d["title"]), d["title"], d["href"])
                elif kind != "navigation":
                    for r in elements(nodes, j, "tr"):
                        links = anchors(nodes, r)
                        text = " ".join(a["text"] for a in links if a["text"]) if links else " · ".join(x for x in (text_of(nodes, c) for c in children(nodes, r) if nodes[c].tag in ("td", "th")) if x)
                        if text:
                            p = add("paragraph", parent, text)
                            for a in links:
                                add("link", p, a["text"], a["href"])
            elif tag == "a":
                if any(nodes[m].tag in ("div", "p", "section", "article", "ul", "table", *HEADINGS) and nodes[m].depth - n.depth <= 5 for m in range(j + 1, n.end)):
                    d = block_link(nodes, j)
                    add("block_link", parent, " — ".join(x for x in (d["title"], d["description"], *d["extra"]) if x), d["href"])
                else:
                    add("link", parent, text_of(nodes, j), n.attrs.get("href", ""), n.attrs.get("id", ""))
            elif tag == "form":
                walk(j, add("form", parent, n.attrs.get("method", "get"), n.attrs.get("action", "")))
            elif tag in ("input", "textarea", "select", "button"):
                add("input", parent, n.attrs.get("value", "") or n.attrs.get("placeholder", ""), n.attrs.get("name", ""), n.attrs.get("id", ""))
            else:
                if n.attrs.get("id"):
                    add("anchor", parent, "", "", n.attrs["id"])
                if tag == "article" and out and out[-1]["type"] != "hr" and any(x["type"] != "anchor" for x in out):
                    add("hr", parent, "───")
                walk(j, parent)

    listing = articles(nodes, root)
    if listing:
        k = add("list", -1)
        for d in listing:
            add("list_item", k, story_text(d), d["href"])
    else:
        walk(root, -1)
    return out


def story_rows(nodes: list[Node], table: int) -> list[dict]:
    """Stories of a table of them: the title and address of each story's row, and the points and comments of the row that follows it."""
    rows = list(elements(nodes, table, "tr"))
    named = lambda j, word: word in nodes[j].attrs.get("class", "")
    out = []
    for k, r in enumerate(rows):
        lines = [j for j in elements(nodes, r, "span") if named(j, "titleline")] if named(r, "athing") else []
        link = next((c for j in lines for c in children(nodes, j) if nodes[c].tag == "a" and text_of(nodes, c)), None)
        if link is None:
            continue
        figures = []
        if k + 1 < len(rows) and not named(rows[k + 1], "athing") and not named(rows[k + 1], "spacer"):
            points = [text_of(nodes, j) for j in elements(nodes, rows[k + 1], "span") if named(j, "score")]
            said = [t for t in (text_of(nodes, j) for j in elements(nodes, rows[k + 1], "a")) if "comment" in t or t == "discuss"]
            figures = [x for x in (*points[-1:], *said[-1:]) if x]
        out.append({"title": text_of(nodes, link), "href": nodes[link].attrs.get("href", ""), "figures": ", ".join(figures)})
    return out


def _cells_of(nodes: list[Node], table: int) -> list[dict]:
    rows = [r for r in elements(nodes, table, "tr") if next(j for j in ancestors(nodes, r) if nodes[j].tag == "table") == table]
    out = []
    for y, r in enumerate(rows):
        for x, c in enumerate([c for c in children(nodes, r) if nodes[c].tag in ("td", "th")]):
            links = anchors(nodes, c)
            text = text_of(nodes, c)
            out.append({"row": y, "col": x, "is_header": nodes[c].tag == "th", "text": text, "href": links[0]["href"] if len(links) == 1 and 2 * nbytes(links[0]["text"]) >= nbytes(text) else ""})
    return out


def looks_like_news_index(content: list[dict]) -> bool:
    """At least three lists, three of them mostly of link-first items, and five links at the top level."""
    lists = [c for c in content if c["type"] == "list"]
    led = 0
    for k in lists:
        items = [c for c in content if c["parent"] == k["ord"] and c["type"] == "list_item"]
        ahead = sum(next((c["type"] == "link" for c in content if c["parent"] == it["ord"]), False) for it in items)
        led += ahead > 0 and ahead >= len(items) // 2
    return len(lists) >= 3 and led >= 3 and sum(c["type"] == "link" and c["parent"] == -1 for c in content) >= 5


_ARTICLE = "array<struct<ord:int,title:string,href:string,description:string,author:string,date:string,source:string>>"
#: Parts of a page: how to make one from its nodes, and its type.
PARTS: dict[str, tuple[Callable, str]] = {
    "lang": (page_language, "string"),
    "title": (page_title, "string"),
    "theme": (theme_candidates, "array<string>"),
    "links": (anchors, "array<struct<ord:int,text:string,href:string,is_image:boolean>>"),
    "navigation": (navigation, "array<struct<label:string,links:array<struct<text:string,href:string>>>>"),
    "feeds": (feed_links, "array<struct<url:string,title:string,type:string>>"),
    "content": (lambda n: content_nodes(n, content_root(n)), "array<struct<ord:int,parent:int,type:string,text:string,href:string,id:string,is_header:boolean>>"),
    "cells": (table_cells, "array<struct<table_ord:int,row:int,col:int,is_header:boolean,text:string,href:string>>"),
    "articles": (lambda n: articles(n, content_root(n)), _ARTICLE),
    "news_index": (lambda n: looks_like_news_index(content_nodes(n, content_root(n))), "boolean"),
    "nodes": (
        lambda n: [{"pre": i, "post": x.end, "parent": x.parent, "depth": x.depth, "tag": x.tag, "text": x.text, "attrs": list(x.attrs.items())} for i, x in enumerate(n)],
        "array<struct<pre:int,post:int,parent:int,depth:int,tag:string,text:string,attrs:map<string,string>>>",
    ),
}


def page_parts(pages: DataFrame, parts: list[str], keep: list[str] = ("page_id",), html: str = "html", more: dict[str, tuple[Callable, str]] | None = None) -> DataFrame:
    """keep columns and the named parts of every page, from one parse; a page that cannot be parsed gives nulls and parse_error true."""
    from pyspark.sql.pandas.types import to_arrow_type

    known = PARTS | (more or {})
    kept = pages.select(*keep, html)
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField(p, T._parse_datatype_string(known[p][1])) for p in parts], T.StructField("parse_error", T.BooleanType())])
    types = [to_arrow_type(f.dataType) for f in schema.fields[len(keep) : -1]]
    makers = [known[p][0] for p in parts]

    def run(batches):
        for batch in batches:
            made: list[tuple] = []
            first = held = 0
            for at, source in enumerate(batch.column(len(keep))):
                source = source.as_py()
                try:
                    nodes = parse(source)
                    made.append((*[make(nodes) for make in makers], False))
                except ValueError:
                    made.append((*[None] * len(makers), True))
                held += HELD_ROW + len(source or "") + HELD_ITEM * sum(len(v) for v in made[-1][:-1] if isinstance(v, list))
                if held >= HELD or at == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), [*types, pa.bool_()], strict=True)]
                    yield pa.RecordBatch.from_arrays([*[c.slice(first, len(made)) for c in batch.columns[: len(keep)]], *columns], names=schema.names)
                    made, first, held = [], at + 1, 0

    return kept.mapInArrow(run, schema)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, text, href, is_image) of every anchor."""
    return page_parts(pages, ["links"]).select("page_id", F.inline("links"))


def nav_links(pages: DataFrame) -> DataFrame:
    """(page_id, section_ord, label, link_ord, text, href)."""
    sections = page_parts(pages, ["navigation"]).select("page_id", F.posexplode("navigation").alias("section_ord", "s"))
    return sections.select("page_id", "section_ord", "s.label", F.posexplode("s.links").alias("link_ord", "l")).select("page_id", "section_ord", "label", "link_ord", "l.text", "l.href")


def content_of(pages: DataFrame) -> DataFrame:
    """(page_id, ord, parent, type, text, href, id, is_header), one row for each content node."""
    return page_parts(pages, ["content"]).select("page_id", F.inline("content"))


#: Content nodes that stand in paragraphs of their own.
TEXT_BLOCKS = ["paragraph", "heading1", "heading2", "heading3", "blockquote", "list_item", "code_block"]


def structured_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): the content as plain text with a blank line between blocks; a block inside another is part of its text."""
    alone = lambda x: x["type"].isin(TEXT_BLOCKS) & (x["text"] != "")
    inner = lambda x: F.coalesce(alone(F.get("content", F.when(x["parent"] >= 0, x["parent"]))), F.lit(False))
    blocks = F.transform(F.filter("content", lambda x: alone(x) & ~inner(x)), lambda x: x["text"])
    return page_parts(pages, ["content"]).select("page_id", F.trim(F.coalesce(F.array_join(blocks, "\n\n"), F.lit(""))).alias("text"))


def headings_of(pages: DataFrame) -> DataFrame:
    level = F.substring("type", 8, 1).cast("int")
    return content_of(pages).where("type in ('heading1', 'heading2', 'heading3')").select("page_id", "ord", level.alias("level"), "text", "id")
