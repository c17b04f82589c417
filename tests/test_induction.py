"""Rules induced on half of each host's pages, against the gate on the other half; hints against plain counts."""

import collections
import random

from pyspark.sql import functions as F

from weftlake.functions.dom import parse
from weftlake.operators import induction, reading, structure

WORDS = "storm river city council votes bridge budget school team wins final match coach mayor harbour plan opens trial".split()


def title(rng):
    return " ".join(rng.choice(WORDS) for _ in range(6)).capitalize()


def news(rng, k):
    menu = "".join(f"<li><a href='/{m}'>{m} section</a></li>" for m in ("Home page", "World news", "Sport today", "Business pages"))
    cards = "".join(f"<div class='card'><h3><a href='/{k}/{i}'>{title(rng)}</a></h3><span>{i} min</span></div>" for i in range(12))
    return f"<body><ul class='menu'>{menu}</ul><div class='list'>{cards}</div><footer><p>Imprint of the paper</p></footer></body>"


def shop(rng, k):
    side = "".join(f"<li><a href='/{x}'>{x} goods of all kinds</a></li>" for x in ("Red", "Blue", "Green"))
    rows = "".join(f"<li><a href='/p{k}-{i}'>{title(rng)}</a></li>" for i in range(15))
    return f"<body><div class='side'><ul>{side}</ul></div><div class='main'><ul>{rows}</ul></div></body>"


def test_rules_hold_on_other_pages(spark):
    rng = random.Random(1)
    rows = [(k, f"https://www.news.org/{k}", news(rng, k)) for k in range(12)] + [(100 + k, f"https://shop.org/{k}", shop(rng, k)) for k in range(12)]
    rows += [(200 + k, f"https://plain.org/{k}", f"<body><p>{title(rng)}</p></body>") for k in range(4)] + [(300, None, "<p>x"), (301, "https://deep.org/", "<div>" * 900)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    rules = induction.induce(pages.where("page_id % 2 = 0"), good=95)
    got = {r.domain: r for r in rules.collect()}
    assert set(got) == {"news.org", "shop.org"} and (got["shop.org"].articles, got["shop.org"].steps) == ("div.main > ul > li", 3)
    read = reading.read_pages(pages.where("page_id % 2 = 1"), rules).collect()
    by_host = collections.Counter((r.host, r.reader) for r in read)
    assert by_host["news.org", "rule"] == 6 and by_host["shop.org", "rule"] == 6 and by_host["plain.org", "default"] == 2
    found = next(r for r in read if r.page_id == 101)
    assert [e.href for e in found.entries] == [f"/p1-{i}" for i in range(15)]
    assert induction.induce(pages.limit(0)).count() == 0


def test_scores_by_brute_force(spark):
    rng = random.Random(2)
    sources = [shop(rng, k) for k in range(3)] + [news(rng, 9)]
    pages = spark.createDataFrame([(k, "https://a.org/", s) for k, s in enumerate(sources)], "page_id int, url string, html string")
    rows = [(k, x) for k, s in enumerate(sources) for x in induction.repeated_items(parse(s))]
    items = spark.createDataFrame([("a.org", k, x["path"], x["text"], x["href"]) for k, x in rows], "host string, page_id int, path array<string>, text string, href string")
    for steps in (1, 2, 3):
        got = {r.selector: (r.score, r.items) for r in induction.candidates(items, steps).collect()}
        want = {}
        for selector in {" > ".join(x["path"][-steps:]) for _, x in rows if len(x["path"]) >= steps}:
            own = collections.defaultdict(list)
            for k, x in rows:
                if len(x["path"]) >= steps and " > ".join(x["path"][-steps:]) == selector:
                    own[k].append(x)
            listed = [v for v in own.values() if 3 <= len(v) <= 100]
            flat = [x for v in listed for x in v]
            if not flat:
                continue
            size = [len(x["text"].encode()) for x in flat]
            good = sum(10 <= n <= 500 and len([c for c in x["text"] if c not in "0123456789."]) > 5 for n, x in zip(size, flat, strict=True)) / len(flat)
            if sum(size) / len(flat) < 15 or good < 0.5:
                continue
            quality = 30 * min(1, len(flat) / len(listed) / 10) + 30 * sum(x["href"] != "" for x in flat) / len(flat) + 20 * min(1, sum(size) / len(flat) / 30) + 20 * good
            every = [x["text"] for v in own.values() for x in v]
            want[selector] = (quality * len(listed) / len(sources) * len(set(every)) / len(every), len(flat) / len(listed))
        assert got.keys() == want.keys() and all(abs(got[s][0] - want[s][0]) < 1e-5 and got[s][1] == want[s][1] for s in want)
    assert pages.count() == 4


def test_hints(spark):
    rng = random.Random(3)
    source = "<main>" + "".join(f"<div class='{rng.choice(['story-card', 'x', 'Wrapper'])}' data-testid='{rng.choice('abc')}'><h2>t</h2></div>" for _ in range(60)) + "</main><nav data-testid='once'></nav>"
    nodes = structure.page_nodes(spark.createDataFrame([(1, source), (2, "<p>none")], "page_id int, html string"))
    got = {(r.kind, r.value): r.n for r in induction.available_selectors(nodes).collect()}
    count = source.count
    want = {("testid", c): count(f"data-testid='{c}'") for c in "abc"} | {("element", "main"): 1, ("element", "nav"): 1, ("element", "h2"): 60}
    want |= {("class", "story-card"): count("'story-card'"), ("class", "x"): count("'x'"), ("part", "card"): count("'story-card'"), ("part", "story"): count("'story-card'")}
    assert got == want and F is not None
