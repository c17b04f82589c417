"""CSS selectors over a flat tree: compiled once, matched right to left. An invalid selector matches nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from weftlake.functions.dom import Node, children, text_of

_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<class>{_NAME})|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+)))?\s*\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?"
)
_NTH = re.compile(r"^\s*(?:(odd|even)|([+-]?\d*)n\s*([+-]\s*\d+)?|([+-]?\d+))\s*$")


class Invalid(ValueError):
    pass


def _nth(arg: str) -> tuple[int, int]:
    m = _NTH.match(arg or "")
    if not m:
        raise Invalid(arg)
    if m[1]:
        return 2, 1 if m[1] == "odd" else 0
    if m[4]:
        return 0, int(m[4])
    step = {"": 1, "+": 1, "-": -1}.get(m[2], None)
    return int(m[2]) if step is None else step, int((m[3] or "0").replace(" ", ""))


def _compound(source: str) -> tuple[list, int]:
    tests, at = [], 0
    while at < len(source):
        m = _SIMPLE.match(source, at)
        if not m or m["tag"] and at:
            break
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(("tag", m["tag"].lower()))
        elif m["id"]:
            tests.append(("id", m["id"].replace("\\", "")))
        elif m["class"]:
            tests.append(("class", m["class"].replace("\\", "")))
        elif m["attr"]:
            value = next((m[k] for k in ("v1", "v2", "v3") if m[k] is not None), None)
            tests.append(("attr", m["attr"].lower(), m["op"], value))
        elif m["pseudo"] in ("not", "has"):
            tests.append((m["pseudo"], compile_selector(m["arg"] or "")))
        elif m["pseudo"] in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
            tests.append((m["pseudo"], *_nth(m["arg"])))
        elif m["pseudo"] in ("first-child", "last-child", "first-of-type", "last-of-type", "only-child", "empty", "root"):
            tests.append((m["pseudo"],))
        elif m["pseudo"] in ("contains", "containsOwn"):
            tests.append((m["pseudo"], (m["arg"] or "").strip("\"'").lower()))
        else:
            raise Invalid(source)
    return tests, at


@lru_cache(maxsize=4096)
def compile_selector(source: str) -> tuple:
    """Alternatives, each a list of (combinator, tests) from left to right. Raises Invalid."""
    alternatives, steps, combinator, at = [], [], " ", 0
    source = source.strip()
    if not source:
        raise Invalid("empty")
    while at < len(source):
        tests, size = _compound(source[at:])
        if not size:
            raise Invalid(source)
        steps.append((combinator, tuple(tests)))
        at += size
        m = re.compile(r"\s*([>+~,])\s*|\s+|$").match(source, at)
        if not m:
            raise Invalid(source)
        at = m.end()
        combinator = m[1] or " "
        if combinator == ",":
            alternatives.append(tuple(steps))
            steps, combinator = [], " "
            if at >= len(source):
                raise Invalid(source)
    if combinator in (">", "+", "~"):
        raise Invalid(source)
    alternatives.append(tuple(steps))
    return tuple(alternatives)


def _siblings(nodes: list[Node], i: int) -> list[int]:
    p = nodes[i].parent
    return [j for j in (children(nodes, p) if p >= 0 else [i]) if nodes[j].tag[0] != "#"]


def _test(nodes: list[Node], i: int, test: tuple) -> bool:
    n, kind = nodes[i], test[0]
    if kind == "tag":
        return n.tag == test[1]
    if kind == "id":
        return n.attrs.get("id") == test[1]
    if kind == "class":
        return "class" in n.attrs and test[1] in n.classes()
    if kind == "attr":
        have, op, want = n.attrs.get(test[1]), test[2], test[3]
        if have is None or op is None:
            return have is not None
        return {
            "=": have == want,
            "~=": want in have.split(),
            "|=": have == want or have.startswith(want + "-"),
            "^=": bool(want) and have.startswith(want),
            "$=": bool(want) and have.endswith(want),
            "*=": bool(want) and want in have,
        }[op]
    if kind == "not":
        return not matches(nodes, i, test[1])
    if kind == "has":
        return any(matches(nodes, j, test[1]) for j in range(i + 1, n.end) if nodes[j].tag[0] != "#")
    if kind in ("contains", "containsOwn"):
        own = text_of(nodes, i) if kind == "contains" else "".join(nodes[j].text for j in children(nodes, i) if nodes[j].tag == "#text")
        return test[1] in own.lower()
    if kind == "empty":
        return not any(nodes[j].tag != "#comment" for j in children(nodes, i))
    if kind == "root":
        return n.parent < 0
    same = _siblings(nodes, i)
    if "of-type" in kind:
        same = [j for j in same if nodes[j].tag == n.tag]
    if "last" in kind:
        same = same[::-1]
    place = same.index(i) + 1
    if kind == "only-child":
        return len(same) == 1
    if kind.startswith("nth"):
        step, start = test[1], test[2]
        return place == start if step == 0 else (place - start) % step == 0 and (place - start) // step >= 0
    return place == 1


def _chain(nodes: list[Node], i: int, steps: tuple, scope: int) -> bool:
    for test in steps[-1][1]:
        if not _test(nodes, i, test):
            return False
    if len(steps) == 1:
        return True
    combinator, rest = steps[-1][0], steps[:-1]
    if combinator in (" ", ">"):
        p = nodes[i].parent
        while p >= 0:
            if _chain(nodes, p, rest, scope):
                return True
            if combinator == ">":
                return False
            p = nodes[p].parent
        return False
    before = _siblings(nodes, i)
    before = before[: before.index(i)]
    return any(_chain(nodes, j, rest, scope) for j in (before[-1:] if combinator == "+" else before))


def matches(nodes: list[Node], i: int, compiled: tuple, scope: int = -1) -> bool:
    for steps in compiled:
        if _chain(nodes, i, steps, scope):
            return True
    return False


def select(nodes: list[Node], selector: str, scope: int | None = None) -> list[int]:
    """Elements under scope (or of the whole page) that match, in document order."""
    return list(found(nodes, selector, scope))


def found(nodes: list[Node], selector: str, scope: int | None = None) -> Iterator[int]:
    """The same one by one, for callers that need only the first."""
    try:
        compiled = compile_selector(selector)
    except (Invalid, RecursionError):
        return
    lo, hi = (0, len(nodes)) if scope is None else (scope + 1, nodes[scope].end)
    for i in range(lo, hi):
        if nodes[i].tag[0] != "#" and matches(nodes, i, compiled):
            yield i
