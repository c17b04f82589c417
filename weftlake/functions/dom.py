"""HTML to a flat tree, by a small tree builder on the standard library.

A tree is a list of nodes in document order; a node is a Node with the index of its parent and of the
node after its subtree, so that "inside" is a comparison of indices.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

#: Fixed values of HTML: elements without content, with raw text, that close an open paragraph, and formatting ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD = frozenset("base link meta title style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
#: Nesting beyond which a page counts as unreadable.
MAX_DEPTH = 512

_TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
#: What closes an open link no further out than this, and what closes no paragraph.
_LINK_STOP = BLOCK - {"p"} | {"td", "th", "body"}
_LINK, _PARAGRAPH = frozenset({"a"}), frozenset({"p"})
_PARAGRAPH_STOP = frozenset({"button", "td", "th", "caption", "table"})
#: Elements that open formatting does not go into again by themselves.
_PLAIN = BLOCK | HEAD | frozenset(CLOSES)
#: Characters of a tag's attributes up to which their reading is remembered; pages repeat the short ones.
_SHORT = 64


class Node:
    __slots__ = ("attrs", "depth", "end", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, depth: int, attrs: dict | None = None, text: str = ""):
        self.tag, self.parent, self.depth, self.attrs, self.text, self.end = tag, parent, depth, attrs or {}, text, 0

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def attributes(source: str) -> dict[str, str]:
    """Attributes by name. The same dict may stand for equal sources, so it must not be changed."""
    return _remembered(source) if len(source) <= _SHORT else _read(source)


def _read(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), _html.unescape(value) if "&" in value else value)
    return out


_remembered = lru_cache(maxsize=4096)(_read)


class _Builder:
    def __init__(self, max_depth: int):
        self.max_depth = max_depth
        self.nodes: list[Node] = []
        self.open: list[int] = []
        self.marks: list[tuple[str, dict]] = []  # formatting elements that are still in force
        self.body_seen = False

    def push(self, tag: str, attrs: dict | None = None) -> None:
        nodes, open_ = self.nodes, self.open
        depth = len(open_)
        if depth >= self.max_depth:
            raise ValueError("nesting too deep")
        node = Node(tag, open_[-1] if depth else -1, depth, attrs)
        if tag not in VOID:
            open_.append(len(nodes))
        nodes.append(node)
        if tag in VOID:
            node.end = len(nodes)

    def pop(self) -> str:
        node = self.nodes[self.open.pop()]
        node.end = len(self.nodes)
        return node.tag

    def leaf(self, tag: str, text: str) -> None:
        node = Node(tag, self.open[-1] if self.open else -1, len(self.open), None, text)
        self.nodes.append(node)
        node.end = len(self.nodes)

    def tags(self) -> list[str]:
        return [self.nodes[i].tag for i in self.open]

    def inside(self, tag: str) -> bool:
        """Whether an element of the tag is open; the nearest ones are looked at first."""
        nodes = self.nodes
        return any(nodes[i].tag == tag for i in reversed(self.open))

    def close(self, wanted: frozenset | set, stop: frozenset | set) -> None:
        """Closes the outermost open element of wanted, and all inside, looking no further out than stop."""
        found, nodes, open_ = None, self.nodes, self.open
        for depth in range(len(open_) - 1, -1, -1):
            tag = nodes[open_[depth]].tag
            if tag in wanted:
                found = depth
            elif tag in stop:
                break
        if found is not None:
            while len(self.open) > found:
                self.pop()

    def frame(self, tag: str) -> None:
        """Opens html, head or body where a tag or text implies them."""
        if not self.open:
            if self.nodes:  # something after </html>: it goes on in the body
                self.open = [0]
                body = next((i for i, n in enumerate(self.nodes) if n.tag == "body"), None)
                if body is not None:
                    self.open.append(body)
            else:
                self.push("html")
        if len(self.open) == 1 and tag not in ("head", "body", "frameset"):
            body = next((i for i, n in enumerate(self.nodes) if n.tag == "body"), None) if self.body_seen else None
            if body is not None:
                self.open.append(body)
            elif tag in HEAD:
                if not any(n.tag == "head" for n in self.nodes[:3]):
                    self.push("head")
            else:
                self.push("body")
                self.body_seen = True
        elif len(self.open) == 2 and self.nodes[self.open[-1]].tag == "head" and tag not in HEAD:
            self.pop()
            if tag != "body":
                self.push("body")
                self.body_seen = True

    def renew(self) -> None:
        """Opens formatting elements again that a block boundary has closed."""
        if self.marks:
            tags = self.tags()
            for tag, attrs in self.marks:
                if tag not in tags:
                    self.push(tag, attrs)

    def start(self, tag: str, source: str) -> None:
        attrs = attributes(source) if source and not source.isspace() else {}
        if tag == "html":
            if not self.nodes:
                self.push("html", attrs)
            return
        if tag in ("head", "body"):
            if any(n.tag == tag for n in self.nodes):
                return
            self.frame(tag)
            if tag == "body":
                self.body_seen = True
            self.push(tag, attrs)
            return
        if len(self.open) < 3:
            self.frame(tag)
        if tag in BLOCK:
            self.close(_PARAGRAPH, _PARAGRAPH_STOP)
        if tag in HEADINGS and self.open and self.nodes[self.open[-1]].tag in HEADINGS:
            self.pop()
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in ("td", "th") and not self.inside("tr"):
            self.push("tr")
        if tag == "a":
            self.marks = [m for m in self.marks if m[0] != "a"]
            self.close(_LINK, _LINK_STOP)
        if self.marks and tag not in _PLAIN:
            self.renew()
        self.push(tag, attrs)
        if tag in FORMATTING:
            if len(self.marks) < 32:
                self.marks.append((tag, attrs))

    def end(self, tag: str) -> None:
        if tag in FORMATTING:
            for i in range(len(self.marks) - 1, -1, -1):
                if self.marks[i][0] == tag:
                    del self.marks[i]
                    break
        if tag == "p" and not self.inside("p"):
            self.frame("p")
            self.push("p")
            self.pop()
            return
        if self.open and self.nodes[self.open[-1]].tag == tag:
            self.nodes[self.open.pop()].end = len(self.nodes)
            return
        for depth in range(len(self.open) - 1, -1, -1):
            open_tag = self.nodes[self.open[depth]].tag
            if open_tag == tag or tag in HEADINGS and open_tag in HEADINGS:
                while len(self.open) > depth:
                    self.pop()
                return
            if tag in FORMATTING and open_tag in BLOCK and open_tag != "p":
                return


def parse(source: str | None, max_depth: int = MAX_DEPTH) -> list[Node]:
    """Nodes of a page in document order: elements, `#text` and `#comment`. Nesting beyond max_depth raises ValueError.

    html, head and body are implied; p, li, dt, dd, table parts and options close where HTML implies it;
    formatting that a block closes is opened again. Text of raw elements is kept as their child.
    """
    out = _Builder(max_depth)
    source = source or ""
    at = 0
    search = _TOKEN.search
    while True:
        m = search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            blank = text.isspace()
            if not blank or out.body_seen and out.open:
                if not blank:
                    if len(out.open) < 3:
                        out.frame("#text")
                    if out.marks:
                        out.renew()
                out.leaf("#text", _html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        comment, closing, tag, own = m.groups()
        if tag is None:
            if comment is not None and out.open:
                out.leaf("#comment", comment)
            continue
        tag = tag.lower()
        if closing:
            out.end(tag)
            continue
        out.start(tag, own)
        if tag in RAW and out.open and out.nodes[out.open[-1]].tag == tag:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            raw = source[at : stop.start()] if stop else source[at:]
            if raw:
                out.leaf("#text", _html.unescape(raw) if tag in ("title", "textarea") else raw)
            out.pop()
            close = source.find(">", stop.end()) if stop else -1
            at = close + 1 if close >= 0 else len(source)
    while out.open:
        out.pop()
    return out.nodes


def formula_of(nodes: list[Node], i: int) -> str:
    """The TeX source that a math element carries as an annotation, '' without one."""
    for j in range(i + 1, nodes[i].end):
        if nodes[j].tag == "annotation" and "tex" in nodes[j].attrs.get("encoding", ""):
            found = next((nodes[k].text for k in children(nodes, j) if nodes[k].tag == "#text"), "")
            if found:
                return found
    return ""


def text_of(nodes: list[Node], i: int, skip: frozenset = frozenset({"script", "style", "noscript", "template"})) -> str:
    """The text under a node, white space collapsed and trimmed. A formula with a TeX annotation is written in Unicode."""
    parts, j = [], i
    while j < nodes[i].end:
        n = nodes[j]
        if n.tag == "#text":
            parts.append(n.text)
            j += 1
        elif n.tag in skip and j != i:
            j = n.end
        elif n.tag == "math" and (source := formula_of(nodes, j)):
            from weftlake.functions.latex import to_unicode

            parts.append(to_unicode(source))
            j = n.end
        else:
            j += 1
    return _BLANKS.sub(" ", "".join(parts)).strip()


def children(nodes: list[Node], i: int) -> list[int]:
    out, j = [], i + 1
    while j < nodes[i].end:
        out.append(j)
        j = nodes[j].end
    return out


def following(nodes: list[Node], i: int):
    """Siblings after a node, one by one."""
    j, end = nodes[i].end, nodes[nodes[i].parent].end if nodes[i].parent >= 0 else 0
    while j < end:
        yield j
        j = nodes[j].end


def ancestors(nodes: list[Node], i: int):
    i = nodes[i].parent
    while i >= 0:
        yield i
        i = nodes[i].parent


def first(nodes: list[Node], test, start: int = 0, end: int | None = None) -> int | None:
    """Index of the first element in document order that passes."""
    for i in range(start, len(nodes) if end is None else end):
        if nodes[i].tag[0] != "#" and test(nodes[i]):
            return i
    return None
