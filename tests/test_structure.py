"""Selectors and nested extraction by plans against the page-wise ones."""

import random

import pytest
from pyspark.sql import functions as F

from weftlake.functions import css
from weftlake.functions.dom import parse
from weftlake.operators import rules, structure

PAGES = [
    "<title>T</title><body><nav><ul><li><a href='/1' class='x y'>One</a><li><a href='/2'>Two</a><li>None</ul></nav><article class='a'><h1 id='top'>Head</h1><p class='x'>First <a href='/3' title='t'>three</a></p><div><p>Second</p><p class='y'>Third</p></div></article></body>",
    "<body><div class='s'><h2>A</h2><div class='s'><h2>B</h2><p data-k='en-us'>b</p></div><p>a</p><p></p></div><div class='s'></div><section lang='en'><p>c</p><span>d</span></section></body>",
    "",
    "<p>only",
]
SELECTORS = [
    "li", "nav li a", "nav > ul > li > a[href]", ".x", "#top", "p, h2", "div.s p", "div.s > p", "h2 + p", "h2 ~ p", "li:first-child", "li:last-child a", "p:nth-child(2n+1)", "p:nth-of-type(2)", "p:not(.x)", "div:has(h2)", "section p:only-child",
    "p:empty", "p:contains('sec')", "[data-k|=en]", "[class~=y]", "a[href^='/']", "a[href$='2']", "a[href*='3']", "html", ":root", "nav li + li > a, article p a", "..bad", "div.s div.s p", "* > p:last-of-type",
]


def made_up(rng):
    out, open_ = [], []
    for _ in range(rng.randint(5, 60)):
        if open_ and rng.random() < 0.4:
            out.append(f"</{open_.pop()}>")
        else:
            tag = rng.choice(["div", "section", "span", "li", "h2", "b", "ul"])
            out.append(f"<{tag} class='{rng.choice(['x', 'y', 'x y', 's', ''])}' href='/{rng.randint(0, 4)}'>w{rng.randint(0, 9)}")
            open_.append(tag)
    return "<body>" + "".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    sources = PAGES + [made_up(rng) for _ in range(40)]
    return sources, structure.page_nodes(spark.createDataFrame(list(enumerate(sources)), "page_id int, html string")).cache()


def elements(nodes, hits):
    place = {i: k for k, i in enumerate(i for i, n in enumerate(nodes) if n.tag[0] != "#")}
    return [place[i] for i in hits]


def test_selectors(pages):
    sources, nodes = pages
    trees = [parse(s) for s in sources]
    for batch in range(0, len(SELECTORS), 6):
        marked = nodes
        own = SELECTORS[batch : batch + 6]
        for k, s in enumerate(own):
            marked = structure.mark(marked, s, f"m{k}")
        rows = marked.select("page_id", "pre", *[f"m{k}" for k in range(len(own))]).collect()
        for k, s in enumerate(own):
            got = {}
            for r in rows:
                if r[f"m{k}"]:
                    got.setdefault(r.page_id, []).append(r.pre)
            assert {p: sorted(v) for p, v in got.items()} == {p: h for p, t in enumerate(trees) if (h := elements(t, css.select(t, s)))}, s
    with pytest.raises(css.Invalid):
        structure.mark(nodes, "p:not(div p)", "m")


RULES = [
    {"Menu": "nav li[]", "Menu.text": "a", "Title": "article h1", "Kind": "article@class"},
    {"Sections": "div.s[]", "Sections.Name": "h2", "Sections.Items": "p[]", "Sections.Items.Lang": "@data-k"},
    {"Top": "body", "Top.Blocks": ".x[]", "Top.Blocks.Words": "span[]", "Top.Blocks.text": "b", "Top.Links": "a@href[]", "First": "h2"},
]


def plain(v):
    """Rows as dicts without the fields that are not there."""
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items() if x is not None}
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("k", range(3))
def test_records(pages, k):
    sources, nodes = pages
    got = {}
    for r in structure.records(nodes, RULES[k]).collect():
        got[r.page_id] = {n: x for n, x in plain(r).items() if n != "page_id"}
    tree = rules.compile_selectors(RULES[k])
    want = {p: e for p, s in enumerate(sources) if (e := rules.extract(parse(s), tree))}
    assert got == want and len(want) > (2 if k else 0)


def test_no_pages(spark):
    nodes = structure.page_nodes(spark.createDataFrame([], "page_id int, html string"))
    assert structure.mark(nodes, "p", "m").count() == 0 and structure.records(nodes, RULES[1]).count() == 0
    assert structure.mark(nodes.withColumn("x", F.lit(1)), "p b", "m").columns[-2:] == ["x", "m"]
