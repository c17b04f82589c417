"""A small interpreter for record templates: fields, pipes, if / else, range, with, variables and a function table."""

from __future__ import annotations

import re
import textwrap

_ACTION = re.compile(r"\{\{(-?)\s*(.*?)\s*(-?)\}\}", re.S)
_WORD = re.compile(r'"(?:[^"\\]|\\.)*"|`[^`]*`|\(|\)|\||:=|,|[^\s()|,"`]+')


def _text(v) -> str:
    """What a value reads as: a record by its text or first text-like field."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, dict):
        for k in ("text", "title", "name", "value"):
            if v.get(k):
                return _text(v[k])
        return next((x for _, x in sorted(v.items()) if isinstance(x, str)), "")
    if isinstance(v, list):
        return "[" + " ".join(_text(x) for x in v) + "]"
    return str(v)


def _empty(v) -> bool:
    return v is None or v is False or (isinstance(v, int | float) and v == 0) or (isinstance(v, str) and not v.strip()) or (isinstance(v, dict | list) and not v)


def _true(v) -> bool:
    return not (v is None or v is False or v == 0 or v == "" or (isinstance(v, dict | list) and not v))


def _truncate(n, v) -> str:
    s = _text(v)
    return s if len(s) <= n else s[:n] if n <= 3 else s[: n - 3] + "..."


def _wrap(n, v) -> str:
    lines = []
    for line in _text(v).split("\n"):
        row = ""
        for word in line.split():
            if row and len(row) + 1 + len(word) > n:
                lines.append(row)
                row = word
            else:
                row = f"{row} {word}" if row else word
        lines.append(row)
    return "\n".join(lines)


def _pad(*args) -> str:
    n, v = args[0], _text(args[-1])
    side = args[1] if len(args) == 3 else "right"
    return v.rjust(n) if side == "left" else v.center(n) if side == "center" else v.ljust(n)


def _box(n, v) -> str:
    inner = max(n - 4, 1)
    rows = [r for line in v.split("\n") for r in (textwrap.wrap(line, inner) or [""])]
    return "\n".join(["┌" + "─" * (n - 2) + "┐", *[f"│ {r:<{inner}} │" for r in rows], "└" + "─" * (n - 2) + "┘"])


def _cols(n, items) -> str:
    shown = [_text(x) for x in items or []]
    width = max(map(len, shown), default=0)
    return "\n".join("  ".join(x.ljust(width) for x in shown[k : k + n]).rstrip() for k in range(0, len(shown), max(n, 1)))


def _link(*args) -> str:
    text, href = (_text(args[0]), _text(args[1])) if len(args) > 1 else (_text(args[0]), args[0].get("href", "") if isinstance(args[0], dict) else "")
    return f"[{text}]({href})" if href else text


def _title(v) -> str:
    return re.sub(r"(?<![\w'])\w", lambda m: m[0].upper(), _text(v))


FUNCTIONS = {
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "title": _title,
    "trim": lambda v: _text(v).strip(),
    "wrap": _wrap,
    "truncate": _truncate,
    "indent": lambda n, v: "\n".join(" " * n + x if x else x for x in _text(v).split("\n")),
    "hr": lambda n, c="─": c * n,
    "pad": _pad,
    "box": _box,
    "cols": _cols,
    "limit": lambda n, v: (v or [])[: max(n, 0)],
    "skip": lambda n, v: (v or [])[max(n, 0) :],
    "first": lambda v: v[0] if v else None,
    "last": lambda v: v[-1] if v else None,
    "join": lambda sep, v: sep.join(_text(x) for x in v or []),
    "concat": lambda *v: "".join(map(_text, v)),
    "split": lambda v, sep: _text(v).split(sep),
    "repeat": lambda v, n: _text(v) * n,
    "replace": lambda old, new, v: _text(v).replace(old, new),
    "contains": lambda v, s: s in _text(v),
    "hasPrefix": lambda v, s: _text(v).startswith(s),
    "default": lambda d, v: d if _empty(v) else v,
    "coalesce": lambda *v: next((x for x in v if not _empty(x)), ""),
    "empty": _empty,
    "notEmpty": lambda v: not _empty(v),
    "bold": lambda v: f"**{_text(v)}**",
    "dim": lambda v: f"~~{_text(v)}~~",
    "link": _link,
    "len": lambda v: len(v) if v is not None else 0,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "not": lambda v: not _true(v),
    "and": lambda *v: next((x for x in v if not _true(x)), v[-1]),
    "or": lambda *v: next((x for x in v if _true(x)), v[-1]),
    "eq": lambda a, *b: any(a == x for x in b),
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "index": lambda v, *ks: _index(v, ks),
    "print": lambda *v: "".join(map(_text, v)),
}


def _index(v, keys):
    for k in keys:
        v = v.get(k) if isinstance(v, dict) else v[k] if v is not None and 0 <= k < len(v) else None
    return v


class TemplateError(ValueError):
    pass


def _parse(source: str) -> list:
    pieces, at = [], 0
    for m in _ACTION.finditer(source):
        text = source[at : m.start()]
        if pieces and pieces[-1][0] == "action" and pieces[-1][2]:
            text = text.lstrip()
        if m[1]:
            text = text.rstrip()
        pieces.append(("text", text))
        if not m[2].startswith("/*"):
            pieces.append(("action", m[2], m[3]))
        at = m.end()
    tail = source[at:]
    pieces.append(("text", tail.lstrip() if pieces and pieces[-1][0] == "action" and pieces[-1][2] else tail))
    place = 0

    def block() -> tuple[list, str | None]:
        """Steps up to the next else or end, and that action."""
        nonlocal place
        steps: list = []
        while place < len(pieces):
            piece = pieces[place]
            place += 1
            if piece[0] == "text":
                if piece[1]:
                    steps.append(piece)
                continue
            head, _, rest = piece[1].partition(" ")
            if head in ("if", "range", "with"):
                steps.append(branch(head, rest))
            elif head in ("else", "end"):
                return steps, piece[1]
            else:
                steps.append(("show", _WORD.findall(piece[1])))
        return steps, None

    def branch(head: str, condition: str) -> tuple:
        """A block with its alternative; an else-if is a block of its own that takes the end along."""
        body, closing = block()
        other: list = []
        if closing is None:
            raise TemplateError("a block is not closed")
        if closing != "end":
            kind, _, further = closing.removeprefix("else").strip().partition(" ")
            if kind in ("if", "with"):
                other = [branch(kind, further)]
            else:
                other, closing = block()
                if closing != "end":
                    raise TemplateError("a block is not closed")
        return head, _WORD.findall(condition), body, other

    root, closing = block()
    if closing is not None:
        raise TemplateError(f"{closing} without a block")
    return root


def _value(words: list[str], dot, names: dict):
    """The value of a pipeline."""
    at = 0

    def term():
        nonlocal at
        w = words[at]
        at += 1
        if w == "(":
            v = pipe()
            at += 1
            if at < len(words) and words[at].startswith(".") and len(words[at]) > 1:
                v = field(v, words[at][1:])
                at += 1
            return v
        if w[0] in '"`':
            return w[1:-1] if w[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), w[1:-1])
        if re.fullmatch(r"-?\d+", w):
            return int(w)
        if re.fullmatch(r"-?\d*\.\d+", w):
            return float(w)
        if w in ("true", "false"):
            return w == "true"
        if w == "nil":
            return None
        if w.startswith("$"):
            name, _, rest = w.partition(".")
            v = names.get(name)
            return field(v, rest) if rest else v
        if w == ".":
            return dot
        if w.startswith("."):
            return field(dot, w[1:])
        if w in FUNCTIONS:
            return _Call(w)
        raise TemplateError(f"unknown function {w}")

    def field(v, path: str):
        for k in path.split("."):
            v = v.get(k) if isinstance(v, dict) else None
        return v

    def command(extra=()):
        nonlocal at
        got = [term()]
        while at < len(words) and words[at] not in ("|", ")"):
            got.append(term())
        args = [FUNCTIONS[x.name]() if isinstance(x, _Call) else x for x in got[1:]] + list(extra)
        if isinstance(got[0], _Call):
            return FUNCTIONS[got[0].name](*args)
        return got[0]

    def pipe():
        nonlocal at
        v = command()
        while at < len(words) and words[at] == "|":
            at += 1
            v = command((v,))
        return v

    return pipe()


class _Call:
    def __init__(self, name: str):
        self.name = name


def render(source: str, data) -> str:
    """The template filled with a record. A field that is not there reads <no value>. Raises TemplateError."""

    def run(block: list, dot, names: dict) -> str:
        out = []
        for step in block:
            kind = step[0]
            if kind == "text":
                out.append(step[1])
            elif kind == "show":
                words = step[1]
                if len(words) > 2 and words[1] in (":=", "=") and words[0].startswith("$"):
                    names[words[0]] = _value(words[2:], dot, names)
                else:
                    v = _value(words, dot, names)
                    out.append("<no value>" if v is None else _text(v))
            else:
                words, loop = step[1], []
                if ":=" in words:
                    cut = words.index(":=")
                    loop, words = [w for w in words[:cut] if w != ","], words[cut + 1 :]
                v = _value(words, dot, names)
                if kind == "range":
                    items = list(enumerate(v)) if isinstance(v, list) else sorted(v.items()) if isinstance(v, dict) else []
                    for k, x in items:
                        own = dict(names)
                        if len(loop) == 2:
                            own[loop[0]], own[loop[1]] = k, x
                        elif loop:
                            own[loop[0]] = x
                        out.append(run(step[2], x, own))
                    if not items:
                        out.append(run(step[3], dot, names))
                elif _true(v):
                    out.append(run(step[2], v if kind == "with" else dot, dict(names) | ({loop[0]: v} if loop else {})))
                else:
                    out.append(run(step[3], dot, dict(names)))
        return "".join(out)

    try:
        return run(_parse(source), data, {"$": data})
    except TemplateError:
        raise
    except (TypeError, AttributeError, IndexError, KeyError) as e:
        raise TemplateError(str(e)) from e
