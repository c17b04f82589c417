"""Selectors and nested extraction as plans over a table of nodes: containment by the order of nodes, no page-wise code after the parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions import css
from weftlake.functions.dom import Node, text_of
from weftlake.operators.content import page_parts
from weftlake.operators.rules import Selector, _href, compile_selectors

NODE = (
    "pre:int,end:int,parent:int,depth:int,tag:string,classes:array<string>,attrs:map<string,string>,text:string,href:string,around:array<int>,"
    "nth:int,nth_last:int,nth_of_type:int,nth_last_of_type:int,bare:boolean"
)


def node_rows(nodes: list[Node]) -> list[dict]:
    """The elements of a page: pre is their place in document order and end the place after the last one inside, so a lies in b if b.pre < a.pre < b.end; around lists what a lies in, from the outside in."""
    out: list[dict] = []
    place: dict[int, int] = {}
    kids: dict[int, list[dict]] = {}
    for i, n in enumerate(nodes):
        if n.tag[0] == "#":
            continue
        up = place.get(n.parent, -1)
        place[i] = len(out)
        inside = [nodes[j].tag for j in range(i + 1, n.end)]
        row = {"pre": len(out), "end": len(out) + 1 + sum(t[0] != "#" for t in inside), "parent": up, "depth": n.depth, "tag": n.tag, "classes": n.classes(), "attrs": dict(n.attrs), "text": text_of(nodes, i), "href": _href(nodes, i), "bare": all(t == "#comment" for t in inside)}
        row["around"] = [*out[up]["around"], up] if up >= 0 else []
        kids.setdefault(up, []).append(row)
        out.append(row)
    for same in kids.values():
        for k, r in enumerate(same):
            r["nth"], r["nth_last"] = k + 1, len(same) - k
        for tag in {r["tag"] for r in same}:
            own = [r for r in same if r["tag"] == tag]
            for k, r in enumerate(own):
                r["nth_of_type"], r["nth_last_of_type"] = k + 1, len(own) - k
    return out


def page_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, pre, end, ...) of every element: the one pass that parses."""
    return page_parts(pages, ["nodes"], more={"nodes": (node_rows, f"array<struct<{NODE}>>")}).select("page_id", F.inline("nodes"))


# ---- selectors ----------------------------------------------------------------------------------

def _document(first: int, last: int):
    return W.Window.partitionBy("page_id").orderBy("pre").rowsBetween(first, last)


def _siblings():
    return W.Window.partitionBy("page_id", "parent").orderBy("pre")


def _place(kind: str, step: int, start: int) -> Column:
    place = F.col({"nth-child": "nth", "nth-last-child": "nth_last", "nth-of-type": "nth_of_type", "nth-last-of-type": "nth_last_of_type"}[kind])
    return place == start if step == 0 else ((place - start) % step == 0) & (F.floor((place - start) / step) >= 0)


def _test(test: tuple) -> Column:
    """A simple condition on one node."""
    kind = test[0]
    if kind == "tag":
        return F.col("tag") == test[1]
    if kind == "class":
        return F.array_contains("classes", test[1])
    if kind == "id":
        return F.coalesce(F.col("attrs")["id"] == test[1], F.lit(False))
    if kind == "attr":
        have, op, want = F.col("attrs")[test[1]], test[2], test[3]
        if op is None:
            return have.isNotNull()
        said = F.lit(want)
        holds = {
            "=": have == said,
            "~=": F.array_contains(F.split(have, r"\s+"), want),
            "|=": (have == said) | F.startswith(have, F.lit(f"{want}-")),
            "^=": F.lit(bool(want)) & F.startswith(have, said),
            "$=": F.lit(bool(want)) & F.endswith(have, said),
            "*=": F.lit(bool(want)) & F.contains(have, said),
        }[op]
        return F.coalesce(holds, F.lit(False))
    if kind == "contains":
        return F.contains(F.lower("text"), F.lit(test[1]))
    if kind == "empty":
        return F.col("bare")
    if kind == "root":
        return F.col("parent") < 0
    if kind == "only-child":
        return (F.col("nth") == 1) & (F.col("nth_last") == 1)
    if kind in ("first-child", "last-child", "first-of-type", "last-of-type"):
        return F.col({"first-child": "nth", "last-child": "nth_last", "first-of-type": "nth_of_type", "last-of-type": "nth_last_of_type"}[kind]) == 1
    if kind.startswith("nth"):
        return _place(kind, test[1], test[2])
    if kind == "not" and all(len(steps) == 1 for steps in test[1]):
        return ~_any([_all([_test(t) for t in steps[0][1]]) for steps in test[1]])
    raise css.Invalid(f"{kind} is not supported in plans")


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def mark(nodes: DataFrame, selector: str, name: str) -> DataFrame:
    """nodes with a boolean column: what the selector matches. An invalid selector matches nothing.

    A step inside another one is a staircase join: subtrees are nested, so a node lies in one of the steps before it exactly if the furthest end of those is beyond it, which is a running maximum in document order. Children meet their
    parents by an equi-join, siblings by a window over their parent's children; :has looks for the next match behind the node.
    """
    try:
        compiled = css.compile_selector(selector)
    except (css.Invalid, RecursionError):
        return nodes.withColumn(name, F.lit(False))
    columns, found = nodes.columns, []
    for a, steps in enumerate(compiled):
        last = None
        for k, (combinator, tests) in enumerate(steps):
            own = []
            for t in tests:
                if t[0] == "has":
                    inner = f"{name}_has{a}_{k}_{len(own)}"
                    nodes = _marked_alternatives(nodes, t[1], inner)
                    own.append(F.coalesce(F.min(F.when(F.col(inner), F.col("pre"))).over(_document(1, W.Window.unboundedFollowing)) < F.col("end"), F.lit(False)))
                else:
                    own.append(_test(t))
            here = _all(own)
            step = f"{name}_{a}_{k}"
            if last is None:
                pass
            elif combinator == ">":
                parents = nodes.where(F.col(last)).select("page_id", F.col("pre").alias("parent"), F.lit(True).alias(f"{step}_in"))
                nodes = nodes.join(parents, ["page_id", "parent"], "left")
                here = here & F.coalesce(F.col(f"{step}_in"), F.lit(False))
            elif combinator == " ":
                here = here & F.coalesce(F.max(F.when(F.col(last), F.col("end"))).over(_document(W.Window.unboundedPreceding, -1)) > F.col("pre"), F.lit(False))
            elif combinator == "+":
                here = here & F.coalesce(F.lag(last).over(_siblings()), F.lit(False))
            else:
                here = here & F.coalesce(F.max(last).over(_siblings().rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(False))
            nodes = nodes.withColumn(step, here)
            last = step
        found.append(F.col(last))
    return nodes.withColumn(name, _any(found)).select(*columns, name)


def _marked_alternatives(nodes: DataFrame, compiled: tuple, name: str) -> DataFrame:
    if any(len(steps) > 1 for steps in compiled):
        raise css.Invalid("steps inside :has are not supported in plans")
    return nodes.withColumn(name, _any([_all([_test(t) for t in steps[0][1]]) for steps in compiled]))


# ---- nested extraction --------------------------------------------------------------------------


def _leaf(s: Selector) -> Column:
    if s.take == "html":
        raise css.Invalid("|html is not supported in plans")
    return F.coalesce(F.col("attrs")[s.take[1:]], F.lit("")) if s.take.startswith("@") else F.col("text")


def _fields(nodes: DataFrame, tree: dict[str, Selector], scopes: DataFrame | None, prefix: str) -> DataFrame:
    """(page_id, scope, fields...) of the scopes (page_id, scope) that have any; without scopes the whole page is one, numbered -1.

    A match belongs to all scopes among the nodes around it: the list of those is exploded for matches only and meets the scopes by an equi-join.
    """
    out = None
    for name, s in tree.items():
        own = f"{prefix}{name}"
        if s.css:
            hits = mark(nodes, s.css, "hit").where("hit").drop("hit")
            if scopes is None:
                hits = hits.withColumn("scope", F.lit(-1))
            else:
                hits = hits.withColumn("scope", F.explode("around")).join(scopes, ["page_id", "scope"])
        elif s.many:
            continue
        elif scopes is None:  # the page itself
            hits = nodes.where("pre = 0").withColumn("scope", F.lit(-1))
        else:
            hits = nodes.join(scopes.withColumn("pre", F.col("scope")), ["page_id", "pre"])
        if s.css and not s.many:
            first = hits.groupBy("page_id", "scope").agg(F.min("pre").alias("pre"))
            hits = hits.join(first, ["page_id", "scope", "pre"])
        value = _leaf(s)
        if s.below:
            inner = _fields(nodes, s.below, hits.select("page_id", F.col("pre").alias("scope")).distinct(), f"{own}.")
            inner = inner.withColumnRenamed("scope", "pre")
            hits = hits.join(inner, ["page_id", "pre"], "left")
            href = F.col("href")
            if "text" in s.below and s.below["text"].css and not s.below["text"].below and not s.below["text"].many:  # the link of the text that was found
                said = F.col(f"`{own}.text`")
                href = F.when(F.coalesce(F.col(f"`{own}.text.href`"), F.lit("")) != "", F.col(f"`{own}.text.href`")).otherwise(href)
            else:
                said = None
            fields = {"text": value, "href": href, "title": F.coalesce(F.col("attrs")["title"], F.lit("")), "class": F.coalesce(F.col("attrs")["class"], F.lit(""))}
            for n in s.below:
                if f"{own}.{n}" in hits.columns:
                    given = F.col(f"`{own}.{n}`")
                    fields[n] = F.coalesce(given, fields[n]) if n in fields and said is not None or n in ("href", "title", "class") and n in fields else given
            value = F.struct(*[v.alias(k) for k, v in fields.items()])
        column = value.alias("v") if s.many else value.alias(own)
        if s.many:
            made = hits.select("page_id", "scope", F.struct("pre", column).alias("x")).groupBy("page_id", "scope").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias(own))
        else:
            made = hits.select("page_id", "scope", column, *([F.col("href").alias(f"{own}.href")] if name == "text" and not s.below else []))
        out = made if out is None else out.join(made, ["page_id", "scope"], "full")
    return out


def records(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(page_id, a column for each top field of the selectors): what rules.extract() finds on each page, as structs and arrays. A field without a match is null; a page without any has no row."""
    tree = compile_selectors(selectors)
    out = _fields(nodes, tree, None, "")
    return out.select("page_id", *[F.col(f"`{n}`") for n in tree if n in out.columns])
