"""Op 9: main text of pages; subtrees that recur on many pages of a host are template and go."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions.dom import BLOCK, Node, parse
from weftlake.llm.common import Scratch, released, small
from weftlake.llm.url_filter import host_of

#: Elements that never hold the article's text.
NEVER = frozenset("head nav footer aside form script style noscript template iframe object embed svg canvas button select option input textarea label fieldset dialog menu audio video map annotation annotation-xml".split())
#: Nesting up to which a page is read as a tree.
DEEPEST = 20_000
#: Words of class, id and role that mark what is beside the article, if the whole name consists of them, of NEUTRAL words and of numbers.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted sidebar aside side widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended comment comments respond reply replies disqus "
    "complementary contentinfo search toolbar skip".split()
)
#: The same outside of an article, where a header is the site's; in one it holds the title.
SITE = frozenset("header masthead banner legal copyright".split())
#: Words that say where or how such an element stands, not what a text is about.
NEUTRAL = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer first last js wp box block container wrapper wrap holder area section region zone slot unit panel bar column col row group list item items "
    "link links icon icons button buttons btn form field title heading header footer thread count media post posts article articles story stories content reading text body image images mobile desktop sticky fixed small large "
    "new the and to for of us me your bottom middle center leaderboard rectangle skyscraper google dfp gpt space placement rail tray strip drawer toggle".split()
)
_BREAKS = BLOCK | frozenset("body html td th tr tbody thead tfoot caption option".split())
_WHITE = re.compile(r"\s+")
#: Blocks that may be template inside an article; headings, by which articles are told apart.
CONTAINERS = frozenset("div section ul ol dl table figure details address center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pages of a host on which a subtree must recur with the share of the host's pages, and pages on which a container is template on any host.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 5, 0.2, 20


def _marked(names: str, words: frozenset) -> bool:
    """Whether a class, id or role, as a whole name, is made of these words: "comments-area" is, "side-by-side" and "search-methods" are not."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        parts = [p for p in re.split(r"[-_:.]+|(?<=[a-z])(?=\d)", name) if p and not p.isdigit()]
        if any(p in words for p in parts) and all(p in words or p in BESIDE or p in NEUTRAL for p in parts):
            return True
    return False


def _beside(n: Node, own: bool) -> bool:
    """Whether an element is beside the article; own says that it stands within one."""
    if n.tag in NEVER or (n.tag == "header" and not own) or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
        return True
    if n.tag in ("html", "body", "article", "main"):
        return False
    names = " ".join(filter(None, map(n.attrs.get, ("class", "id", "role"))))
    return bool(names) and (_marked(names, BESIDE) or not own and _marked(names, SITE))


def _is_own(n: Node) -> bool:
    return n.tag in ("article", "main") or n.attrs.get("role") == "main"


def _root(nodes: list[Node]) -> list[int]:
    """The article: all outermost article elements outside of what is beside it, else the main element, else the body."""
    found, i, mains = [], 0, []
    while i < len(nodes):
        n = nodes[i]
        if n.tag[0] != "#" and _beside(n, False):
            i = n.end
        elif n.tag == "article":
            found.append(i)
            i = n.end
        else:
            if _is_own(n):
                mains.append(i)
            i += 1
    if found:
        return found
    return mains[:1] or [i for i, n in enumerate(nodes) if n.tag == "body"][:1]


def _tree(source: str | None) -> list[Node]:
    try:
        return parse(source, DEEPEST)
    except ValueError:  # too deep: a flat reading keeps the text
        flat = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|</?(?!p\b|article\b|nav\b|footer\b|header\b|aside\b|form\b)[a-z][^>]*>", " ", source or "")
        try:
            return parse(flat, DEEPEST)
        except ValueError:
            return parse(re.sub(r"<[^>]*>", " ", flat))


def _digest(nodes: list[Node], i: int) -> int:
    """64 bits that stand for a subtree: tags, classes, ids and text, not link targets."""
    h = hashlib.blake2b(digest_size=8)
    for j in range(i, nodes[i].end):
        n = nodes[j]
        if n.tag != "#comment":
            h.update(f"{n.depth - nodes[i].depth}<{n.tag} {n.attrs.get('class', '')} {n.attrs.get('id', '')}>{_WHITE.sub(' ', n.text)}\0".encode("utf-8", "replace"))
    return int.from_bytes(h.digest(), "big", signed=True)


def _bits(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _says(nodes: list[Node], i: int) -> bool:
    return any(nodes[j].tag == "#text" and not nodes[j].text.isspace() for j in range(i + 1, nodes[i].end))


class _Page:
    """What tells a page from its copies when a block of it is left out: the headings of its articles around the block, or all their text if there is no heading; by running sums of hashes."""

    def __init__(self, nodes: list[Node], roots: list[int]):
        self.heads, self.counts, self.texts = [0], [0], [0]
        ends = iter([(r, nodes[r].end) for r in roots])
        begin, end = next(ends, (len(nodes), len(nodes)))
        head, inside = None, 0  # the heading that is open, and the end of it
        for j, n in enumerate(nodes):
            if j >= end:
                begin, end = next(ends, (len(nodes), len(nodes)))
            heads = texts = count = 0
            if begin <= j < end:
                if n.tag in _HEADINGS and j >= inside:
                    head, inside = j, n.end
                if n.tag == "#text" and not n.text.isspace():
                    texts = _bits(_WHITE.sub(" ", n.text).strip())
                    if head is not None and j < inside:
                        heads, count = texts, 1
            self.heads.append(self.heads[-1] + heads)
            self.texts.append(self.texts[-1] + texts)
            self.counts.append(self.counts[-1] + count)

    def around(self, i: int, end: int) -> int:
        out = lambda sums: sums[i] + sums[-1] - sums[end]
        found = out(self.heads) if out(self.counts) else out(self.texts) + 1
        return (found + (1 << 63)) % (1 << 64) - (1 << 63)


def _template_candidates(nodes: list[Node]) -> dict[int, tuple[int, int | None, bool]]:
    """Digest of each element that may be template, what tells its page from copies, and whether it is a container.

    What stands around articles counts on each page; the outermost elements are enough. What stands inside the article, or inside the body of a page that marks no article, counts once for
    each wording of the headings (without any: of the text) around it, so that the text of a page that is published or mirrored many times stays. Inside a marked article
    paragraphs and headings are the page's own even if other pages have the same passage; containers may be template, with their
    path of tags as part of the digest, and so may each of several articles. In an unmarked page all blocks may, but what is no container only by its share of the pages, so that a quoted passage stays.
    """
    roots = _root(nodes)
    own = [r for r in roots if _is_own(nodes[r])]
    out: dict[int, tuple[int, int | None, bool]] = {}
    i = next((k for k, n in enumerate(nodes) if n.tag == "body"), len(nodes)) + 1 if own else len(nodes)
    while i < len(nodes):  # around the articles
        n = nodes[i]
        if i in own or n.tag[0] == "#":
            i = n.end
        elif any(i < r < n.end for r in own):
            i += 1
        else:
            if _says(nodes, i):
                out[i] = (_digest(nodes, i), None, True)
            i = n.end
    page = _Page(nodes, roots)
    for r in roots:
        within = r in own
        if within and len(own) > 1 and _says(nodes, r):
            out[r] = (_digest(nodes, r), page.around(r, nodes[r].end), True)
        path: list[int] = []
        i = r + 1
        while i < nodes[r].end:
            n = nodes[i]
            if n.tag[0] == "#":
                i += 1
            elif _beside(n, within):
                i = n.end
            else:
                while path and nodes[path[-1]].end <= i:
                    path.pop()
                if n.tag in (CONTAINERS if within else _BREAKS) and _says(nodes, i):
                    digest = _bits(f"{_digest(nodes, i)} {'/'.join(nodes[j].tag for j in path)}") if within else _digest(nodes, i)
                    out[i] = (digest, page.around(i, n.end), n.tag in CONTAINERS)
                path.append(i)
                i += 1
    return out


def extract_text(source: str | None, template: set | frozenset = frozenset()) -> str:
    """Main text of one page; template holds digests of subtrees to leave out."""
    nodes = _tree(source)
    gone = {i for i, (h, *_) in _template_candidates(nodes).items() if h in template} if template else set()
    blocks: list[str] = []
    parts: list[str] = []

    def flush():
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(text)
        parts.clear()

    for r in _root(nodes):
        if r in gone:
            continue
        within = _is_own(nodes[r])
        flush()
        ends: list[int] = []
        i = r + 1
        while i < nodes[r].end:
            while ends and ends[-1] <= i:
                ends.pop()
                flush()
            n = nodes[i]
            if n.tag == "#text":
                parts.append(n.text)
                i += 1
            elif n.tag == "#comment":
                i += 1
            elif i in gone or _beside(n, within):
                if n.tag in _BREAKS:
                    flush()
                i = n.end
            else:
                if n.tag == "br":
                    parts.append(" ")
                elif n.tag in _BREAKS:
                    flush()
                    ends.append(n.end)
                i += 1
        flush()
    return "\n".join(blocks)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html, ...); other columns are ignored, an empty table gives no rows.

    Elements that are never content go (menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, reader comments, by tag, class, id and role). Subtrees go as well
    that recur on min_pages pages of their host and min_share of its pages, and containers that recur on many_pages of any host: all
    are hashed and counted over the whole table. In an article or main element these are containers only; there and in a page without one pages count
    by their headings or texts, so mirrored pages count once (see _template_candidates). An article keeps its own header. A null or empty html has an empty text; a null
    url counts as the host ''; repeated rows count as pages and each give a row. Pages nested too deeply are read flat.
    """
    scratch = Scratch(pages.sparkSession, "template")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))

    def count(batches):
        for batch in batches:
            found = [
                (host, key, *found)
                for host, key, source in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for found in set(_template_candidates(_tree(source)).values())
            ]
            hosts, keys, hashes, around, whole = zip(*found, strict=True) if found else ((), (), (), (), ())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((hosts, keys, hashes, around, whole), kinds, strict=True)], ["host", "key", "hash", "around", "whole"])

    blocks = scratch.keep(rows.select("host", F.xxhash64("html").alias("key"), "html").mapInArrow(released(count), "host string, key long, hash long, around long, whole boolean"), "blocks")
    # a page has a block once, or counts once with all that have the same headings around it
    seen = blocks.groupBy("host", "hash", "around").agg(F.count("*").alias("n"), F.max("whole").alias("whole"))
    seen = seen.groupBy("host", "hash").agg(F.sum(F.when(F.col("around").isNull(), F.col("n")).otherwise(1)).alias("n"), F.max("whole").alias("whole")).where(F.col("n") >= min_pages)
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    common = scratch.keep(scratch.keep(seen, "seen").join(sizes, "host").where((F.col("whole") & (F.col("n") >= many_pages)) | (F.col("n") >= min_share * F.col("pages"))).select("host", "hash"), "common")
    # each page has a list of its own template subtrees, which does not grow with its host
    lists = blocks.join(small(common), ["host", "hash"]).groupBy("host", "key").agg(F.collect_set("hash").alias("template"))

    def extract(batches):
        for batch in batches:
            texts = [extract_text(s, frozenset(t or ())) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.withColumn("key", F.xxhash64("html")).join(small(scratch.keep(lists, "lists"), 20_000), ["host", "key"], "left").select("page_id", "url", "html", "template")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = joined.mapInArrow(released(extract), f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of the table pages; see main_text for nulls, empty and long pages and repeated rows."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
