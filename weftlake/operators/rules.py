"""Declarative extraction rules: selector programs over pages, page-type matching and quality scores."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions import css
from weftlake.functions.dom import Node, ancestors, parse, text_of
from weftlake.functions.template import TemplateError, render


@dataclass
class PageType:
    """What pages a type fits and what to extract; all conditions of a matcher must hold, an empty one never does."""

    selectors: dict[str, str]
    url_pattern: str = ""
    url_contains: str = ""
    has_selector: str = ""
    not_selector: str = ""
    template: str = ""
    default: bool = False


@dataclass
class Rule:
    domain: str
    page_types: dict[str, PageType] = field(default_factory=dict)


# ---- first version: one list of items ------------------------------------------------------------


def apply_list_rule(nodes: list[Node], rule: dict) -> list[dict]:
    """Items of root > articles: title, href, metadata. rule: root, articles, title, metadata, table_layout."""
    scopes = css.select(nodes, rule["root"]) if rule.get("root") else [0]
    out = []
    for scope in scopes[:1]:
        for i in css.select(nodes, rule.get("articles") or rule["title"], scope):
            hits = css.select(nodes, rule["title"], i) if rule.get("articles") and rule.get("title") else []
            at = hits[0] if hits else i
            title = text_of(nodes, at)
            if not title:
                continue
            options = [at, *css.select(nodes, "a", at)[:1], nodes[at].parent, i, *css.select(nodes, "a", i)]
            href = next((nodes[k].attrs["href"] for k in options if k >= 0 and nodes[k].tag == "a" and nodes[k].attrs.get("href") not in (None, "", "#")), "")
            meta = ""
            if rule.get("metadata"):
                where = i
                if rule.get("table_layout"):
                    after = nodes[i].end
                    while after < len(nodes) and nodes[after].parent == nodes[i].parent and nodes[after].tag[0] == "#":
                        after = nodes[after].end
                    where = after if after < len(nodes) and nodes[after].parent == nodes[i].parent else i
                found = css.select(nodes, rule["metadata"], where)
                meta = re.sub(r"[\n\t]", " ", re.sub(" +", " ", text_of(nodes, found[0]))).strip() if found else ""
            out.append({"ord": len(out), "title": title, "href": href, "metadata": meta})
    return out


# ---- second version: a tree of selectors -----------------------------------------------------------


@dataclass
class Selector:
    css: str = ""
    many: bool = False
    take: str = ""  # "", "html" or an attribute with @
    below: dict[str, Selector] = field(default_factory=dict)


def compile_selectors(selectors: dict[str, str]) -> dict[str, Selector]:
    """Dotted names as a tree. A selector may end in [] (many) and hold @attribute or |html before that; [] counts only at the very end."""
    tree: dict[str, Selector] = {}
    for name in sorted(selectors):
        level, node = tree, None
        for part in name.split("."):
            node = level.setdefault(part, Selector())
            level = node.below
        source = selectors[name].strip()
        node.many = source.endswith("[]")
        source = source.removesuffix("[]").strip()
        if source.endswith("|html"):
            source, node.take = source.removesuffix("|html"), "html"
        elif m := re.search(r"@([\w-]+)$", source):
            source, node.take = source[: m.start()], f"@{m[1]}"
        node.css = source.removesuffix("[]").strip()
    return tree


def output_type(tree: dict[str, Selector]) -> str:
    """The Spark type of what a tree extracts: a leaf is text, a node with fields below a struct, many an array."""
    fields = []
    for name, s in tree.items():
        own = output_type({"text": Selector(), "href": Selector(), "title": Selector(), "class": Selector(), **s.below}) if s.below else "string"
        fields.append(f"`{name}`:{f'array<{own}>' if s.many else own}")
    return f"struct<{','.join(fields)}>"


def _source(nodes: list[Node], i: int) -> str:
    n = nodes[i]
    if n.tag[0] == "#":
        return n.text if n.tag == "#text" else ""
    inside, j = [], i + 1
    while j < n.end:
        inside.append(_source(nodes, j))
        j = nodes[j].end
    attrs = "".join(f' {k}="{v}"' for k, v in n.attrs.items())
    return f"<{n.tag}{attrs}>{''.join(inside)}</{n.tag}>"


def _href(nodes: list[Node], i: int) -> str:
    if nodes[i].attrs.get("href"):
        return nodes[i].attrs["href"]
    inner = next((j for j in range(i + 1, nodes[i].end) if nodes[j].tag == "a"), None)
    if inner is not None:
        return nodes[inner].attrs.get("href", "")
    outer = next((j for j in ancestors(nodes, i) if nodes[j].tag == "a"), None)
    return nodes[outer].attrs.get("href", "") if outer is not None else ""


def extract(nodes: list[Node], tree: dict[str, Selector], scope: int | None = None) -> dict:
    """A record of what a tree selects under scope. A selector without a hit leaves its field out, and all below it."""
    out: dict = {}
    for name, s in tree.items():
        if s.css:
            hits = css.select(nodes, s.css, scope)
            if not s.many:
                hits = hits[:1]
        else:
            hits = [0 if scope is None else scope] if not s.many else []
        if not hits:
            continue
        values = []
        for i in hits:
            if s.take.startswith("@"):
                leaf = nodes[i].attrs.get(s.take[1:], "")
            elif s.take == "html":
                leaf = "".join(_source(nodes, j) for j in _kids(nodes, i))
            else:
                leaf = text_of(nodes, i)
            if not s.below:
                values.append(leaf)
                continue
            record = {"text": leaf, "href": _href(nodes, i), "title": nodes[i].attrs.get("title", ""), "class": nodes[i].attrs.get("class", "")}
            inner = extract(nodes, s.below, i)
            if "text" in inner and isinstance(inner["text"], str) and s.below.get("text"):
                hit = css.select(nodes, s.below["text"].css, i)
                if hit and _href(nodes, hit[0]):
                    record["href"] = _href(nodes, hit[0])
            values.append(record | inner)
        out[name] = values if s.many else values[0]
    return out


def _kids(nodes: list[Node], i: int):
    j = i + 1
    while j < nodes[i].end:
        yield j
        j = nodes[j].end


def collect_links(record) -> list[dict]:
    """Links of a nested record in order of field names."""
    out = []
    if isinstance(record, list):
        for x in record:
            out += collect_links(x)
    elif isinstance(record, dict):
        text = record.get("text") or record.get("title")
        if record.get("href") and isinstance(text, str) and text:
            out.append({"text": text, "href": record["href"]})
        for k in sorted(record):
            if isinstance(record[k], dict | list):
                out += collect_links(record[k])
    return out


def page_type_matches(t: PageType, url: str, nodes: list[Node]) -> bool:
    if not (t.url_pattern or t.url_contains or t.has_selector or t.not_selector):
        return False
    if t.url_pattern:
        try:
            if not re.search(t.url_pattern, url):
                return False
        except re.error:
            return False
    if t.url_contains and t.url_contains.lower() not in url.lower():
        return False
    if t.has_selector and not css.select(nodes, t.has_selector):
        return False
    return not (t.not_selector and css.select(nodes, t.not_selector))


def pick_page_type(rule: Rule, url: str, nodes: list[Node]) -> str | None:
    """The first type by name that fits, else the default."""
    for name in sorted(rule.page_types):
        if page_type_matches(rule.page_types[name], url, nodes):
            return name
    return next((n for n in sorted(rule.page_types) if rule.page_types[n].default), None)


def apply_rules(pages: DataFrame, rules: list[Rule], default: Rule | None = None) -> DataFrame:
    """(page_id, url, page_type, record, links, text): what the rule of each page's host extracts, or default for a host without one.

    The record is JSON, as rules differ in their fields; from_json with output_type() of a
    rule's compiled selectors types it. Pages whose host has no rule, or of no fitting type, give no row.
    Without a default, only the rows of hosts that have a rule reach Python; rules are configuration and travel with the plan.
    """
    from weftlake.functions.urls import normal_host

    by_host = {re.sub(r"^www\.", "", r.domain.lower()): r for r in rules}
    programs = {(h, n): compile_selectors(t.selectors) for h, r in [*by_host.items(), *([(None, default)] if default else [])] for n, t in r.page_types.items()}
    rows = pages.select("page_id", "url", normal_host(F.col("url")).alias("host"), "html").where(F.col("host").isNotNull() if default else F.col("host").isin(*by_host) if by_host else F.lit(False))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for ident, url, host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    nodes = parse(source)
                except ValueError:
                    continue
                rule = by_host.get(host, default)
                name = pick_page_type(rule, url, nodes)
                if name is None:
                    continue
                record = extract(nodes, programs[host if host in by_host else None, name]) | {"_domain": host, "_url": url, "_pageType": name}
                try:
                    text = render(rule.page_types[name].template, record) if rule.page_types[name].template else ""
                except TemplateError:
                    text = None
                for column, v in zip(out, (ident, url, name, json.dumps(record, ensure_ascii=False, sort_keys=True), collect_links(record), text), strict=True):
                    column.append(v)
            link = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))
            types = [batch.column(0).type, pa.string(), pa.string(), pa.string(), link, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["page_id", "url", "page_type", "record", "links", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, page_type string, record string, links array<struct<text:string,href:string>>, text string")


def list_items(pages: DataFrame, rule: dict) -> DataFrame:
    """(page_id, ord, title, href, metadata) of a list rule over pages."""
    from weftlake.operators.content import page_parts

    made = {"items": (lambda n: apply_list_rule(n, rule), "array<struct<ord:int,title:string,href:string,metadata:string>>")}
    return page_parts(pages, ["items"], more=made).select("page_id", F.inline("items"))


# ---- quality -------------------------------------------------------------------------------------


def item_quality(items: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, items, avg_title_bytes, link_ratio, good_ratio, score): score is 0 to 100 of count, links, title length and good titles."""
    size = F.octet_length("title")
    marks = F.length(F.regexp_replace("title", r"[0-9.]", ""))
    good = size.between(10, 500) & (marks > 5)
    out = items.groupBy(key).agg(
        F.count("*").alias("items"),
        F.avg(size).alias("avg_title_bytes"),
        F.avg(F.when(F.col("href") != "", 1.0).otherwise(0.0)).alias("link_ratio"),
        F.avg(F.when(good, 1.0).otherwise(0.0)).alias("good_ratio"),
    )
    score = 30 * F.least(F.lit(1.0), F.col("items") / 10) + 30 * F.col("link_ratio") + 20 * F.least(F.lit(1.0), F.col("avg_title_bytes") / 30) + 20 * F.col("good_ratio")
    return out.withColumn("score", score)


def beats_default(quality: DataFrame, layout: Column) -> Column:
    """Whether a rule's items are good enough to replace the default reading."""
    listed = layout.isin("list", "newspaper")
    return (F.col("items") >= 3) & (F.col("avg_title_bytes") >= 15) & (F.col("good_ratio") >= 0.5) & (~listed | (F.col("link_ratio") >= 0.3))


def selector_issues(selector: Column) -> Column:
    """What makes a selector brittle, as an array."""
    steps = F.size(F.split(F.trim(selector), r"\s*>\s*|\s+"))
    child = F.length(selector) - F.length(F.replace(selector, F.lit(">")))
    checks = [
        (selector.rlike(":nth-"), "position"),
        (F.exists(F.regexp_extract_all(selector, F.lit(r"\.([A-Za-z0-9_-]+)"), F.lit(1)), lambda c: (F.length(c) > 20) & ~F.contains(c, F.lit("-"))), "generated class"),
        (child > 3, "many child steps"),
        (steps > 6, "deep"),
        (selector.rlike(r"#[A-Za-z_-]*[0-9]{10,}"), "numeric id"),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in checks]), lambda x: x.isNotNull())


def selector_counts(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(page_id, name, matches): how many elements each selector hits."""
    from weftlake.operators.content import page_parts

    made = {"hits": (lambda n: [{"name": k, "matches": len(css.select(n, re.sub(r"(\[\]|@[\w-]+|\|html)+$", "", v)))} for k, v in sorted(selectors.items())], "array<struct<name:string,matches:int>>")}
    return page_parts(pages, ["hits"], more=made).select("page_id", F.inline("hits"))


def frequent_attributes(pages: DataFrame, attribute: str = "class", least: int = 10, most: int = 100, top: int = 8) -> DataFrame:
    """(page_id, value, n): per page the attribute values that occur between least and most times, the top most frequent."""
    from weftlake.operators.content import page_parts

    made = {"values": (lambda n: [v for x in n for v in x.attrs.get(attribute, "").split()], "array<string>")}
    counts = page_parts(pages, ["values"], more=made).select("page_id", F.explode("values").alias("value")).groupBy("page_id", "value").agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("page_id").orderBy(F.desc("n"), "value")
    return counts.where(F.col("n").between(least, most)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).drop("k")
