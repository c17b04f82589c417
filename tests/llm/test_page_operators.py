"""URL filters, main text and vector dedup against brute force and SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlake.llm import common, main_text, queries, url_filter, vector_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    want, got = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, SF)
    names = sorted(want.columns)
    assert set(names) <= set(got.columns)
    rows = lambda found: sorted(tuple(str(v) for v in r) for r in found)
    assert rows(got.select(*names).collect()) == rows(want.select(*[f'"{c}"' for c in names]).fetchall())


def test_url_filter(spark):
    cases = {
        "https://A.Example.COM/en/1?x": ("a.example.com", "/en/1", "com/en/", "block"),
        "http://example.com/en/71#t": ("example.com", "/en/71", "example.com/en/7", "allow"),
        "x://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://b.example.net/de/8": ("b.example.net", "/de/8", "example.net/de/8", "block"),
        "http://net/de/": ("net", "/de/", "net/de/", "allow"),
        "http://org": ("org", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "a." * 3000 + "org/es/" + "y" * 5000: ("a." * 3000 + "org", "/es/" + "y" * 5000, "org/es/", "block"),
        "a://b://c.com/en/": ("b:", "//c.com/en/", None, "allow"),
    }
    rows = [(k, u, "clash") for k, u in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id int, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = url_filter.judge_urls(df, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, rules.limit(0), otherwise="block").collect()} == {"block"}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>x</style></head><body><nav>menu</nav><div class="cookie-notice">cookies</div>
<article><h1>Title &amp; more</h1><p>First<br>line &lt;b&gt;<p>Second <b>bold</b> <i>x</i>&nbsp;y</p><aside>side</aside><form><input><p>f</p></form><script>var a="<p>";</script>
<ul><li>one<li>two</ul><section id="comments"><p>reader</p></section><div class="share-links">share</div>tail</article><footer>foot"""


def test_main_text(spark):
    want = "Title & more\nFirst line <b>\nSecond bold x y\none\ntwo\ntail"
    assert main_text.extract_text(PAGE) == want
    template = '<body><div><p>Home page of the site</p></div><div><p>Text number {0} is its own.</p></div><div><p>All rights</p></div>'
    rows = [(1, "http://h.com/1", PAGE, "clash"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "<div>" * 900 + "deep &amp; text", "c"), (1, "http://h.com/1", PAGE, "clash"), (5, "u", "<article>" + "<p>long text</p>" * 20000, "c")]
    rows += [(100 + k, f"http://site.com/{k}", template.format(k), "c") for k in range(8)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = main_text.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].text == want and by[2].text == "" and by[3].text == "" and by[4].text == "deep & text" and by[5].text.count("\n") == 19999
    assert all(by[100 + k].text == f"Text number {k} is its own." for k in range(8))
    assert main_text.main_text(df.limit(0)).count() == 0


def test_article_keeps_its_own():
    page = """<body><header>Site</header><p class="legal">Imprint</p><article><header class="article-header"><h1>The title</h1></header><p>One</p><p class="legal">It is law.</p>
<div class="discussion"><p>Findings.</p></div><p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> holds.</p><footer>Filed under x</footer><div class="cookie-notice">c</div></article></body>"""
    assert main_text.extract_text(page) == "The title\nOne\nIt is law.\nFindings.\nSo E=m holds."
    deep = "<body><article>" + "<div>" * 5000 + "<nav>menu</nav><p>deep text</p>" + "</div>" * 5000 + "<p>after</p></article>"
    assert main_text.extract_text(deep) == "deep text\nafter"


def test_recurring_articles(spark):
    page = "<nav>menu</nav><article><h1>Title {0}</h1><p>Text {0} is its own.</p></article><article><h2>Join us</h2><p>Our club.</p></article><footer>foot</footer>"
    rows = [(k, f"http://a.com/{k}", page.format(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert all(r.text == f"Title {r.page_id}\nText {r.page_id} is its own." for r in main_text.main_text(df).collect())


def test_template_in_articles(spark):
    page = "<article><h1>Title {0}</h1><p>Text {0} is its own.</p><p>A passage that all share.</p><div class='x'><p>Read our terms.</p></div></article>"
    copy = "<article><h1>One report</h1><p>Edition {0}.</p><table><tr><td>Data of the report</td></tr></table></article>"
    rows = [(k, f"http://a.com/{k}", page.format(k)) for k in range(30)] + [(100 + k, f"http://b.com/{k}", copy.format(k)) for k in range(30)]
    by = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(by[k] == f"Title {k}\nText {k} is its own.\nA passage that all share." for k in range(30))
    assert all(by[100 + k] == f"One report\nEdition {k}.\nData of the report" for k in range(30))


def test_template_of_a_section(spark):
    rows = [(k, f"http://a.com/{k}", f"<body><div><p>Text {k} is its own.</p></div>" + "<div>Section of sports</div>" * (k < 25)) for k in range(200)]
    rows += [(1000 + k, f"http://b.com/{k}", f"<body><p>Text {k}.</p>" + "<div>Four pages say so</div>" * (k < 4)) for k in range(10)]
    by = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(by[k] == f"Text {k} is its own." for k in range(200))
    assert all(by[1000 + k].endswith("Four pages say so") for k in range(4))


def test_mirrored_and_quoted(spark):
    """Mirrored pages without an article element keep their text, as does a passage that few of many pages quote; whole names mark what is beside."""
    mirror = "<body><h2>On wells</h2><p>Water is deep.</p><p>So dig.</p></body>"
    bare = "<body><p>Water is deep here.</p><p>So dig on.</p></body>"
    plain = "<body><p>Text {0} is its own.</p>{1}<p>More of {0}.</p><p>Published by the club.</p></body>"
    rows = [(k, f"http://m.com/{k}", mirror) for k in range(25)] + [(100 + k, f"http://n.com/{k}", bare) for k in range(25)]
    rows += [(1000 + k, f"http://q.com/{k}", plain.format(k, "<p>As the old saying goes.</p>" * (k < 30))) for k in range(300)]
    by = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(by[k] == "On wells\nWater is deep.\nSo dig." and by[100 + k] == "Water is deep here.\nSo dig on." for k in range(25))
    assert all(by[1000 + k] == f"Text {k} is its own.\n" + "As the old saying goes.\n" * (k < 30) + f"More of {k}." for k in range(300))
    named = "<article><h1>T</h1>{0}</article>"
    own = ["side-by-side", "related-work", "share-price-table", "notice-of-meeting", "research", "asides", "commentary", "navy"]
    gone = ["sidebar", "site-nav", "comments-area", "related-posts", "ad", "ad-slot-3", "cookieBanner", "social share", "newsletter_signup", "post-comments", "share-buttons"]
    assert all(main_text.extract_text(named.format(f'<div class="{c}"><p>x</p></div><section id="{c}">y</section>')) == "T\nx\ny" for c in own)
    assert all(main_text.extract_text(named.format(f'<div class="{c}"><p>x</p></div>z')) == "T\nz" for c in gone)


def brute_template(pages):
    """Template blocks by the stated rule, over parsed pages in memory."""
    counts, sizes = {}, {}
    for host, source in pages:
        sizes[host] = sizes.get(host, 0) + 1
        for h, around, whole in set(main_text._template_candidates(main_text._tree(source)).values()):
            n, known, is_whole = counts.get((host, h), (0, set(), False))
            counts[host, h] = (n + (around is None), known | ({around} if around is not None else set()), is_whole or whole)
    return {k for k, (n, known, whole) in counts.items() if n + len(known) >= 5 and (n + len(known) >= 0.2 * sizes[k[0]] or whole and n + len(known) >= 20)}


def test_template_counts_by_brute_force(spark):
    """The table's pages, and pages on which only the template step decides."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    made = [(10_000 + k, f"http://w.com/{k % 7}/{k}", f"<body><div><p>Our paper since 1900</p></div><div><p>Story {k} of the day.</p><ul><li>fact {k}</li></ul></div><div><p>Read all about it</p></div></body>") for k in range(40)]
    df = df.unionByName(spark.createDataFrame(made, "page_id long, url string, html string"))
    rows = df.withColumn("host", url_filter.host_of(F.col("url"))).collect()
    template = brute_template([(r.host, r.html) for r in rows])
    want = {r.page_id: main_text.extract_text(r.html, frozenset(h for host, h in template if host == r.host)) for r in rows}
    got = {r.page_id: r.text for r in main_text.main_text(df).collect()}
    assert got == want and len(template) > 2 and all(got[10_000 + k] == f"Story {k} of the day.\nfact {k}" for k in range(40))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 64))
    rows, k = [], 0
    for i in range(30):
        for noise in (0, 0, 0.05, 0.1, 0.15, 0.2, 0.3):
            rows.append((k, (base[i] + noise * rng.standard_normal(64)).astype("float32").tolist(), int(i % 3) if i else None))
            k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 64, 1), (k + 2, [float("nan")] * 64, 1), (k + 3, [1.0, float("inf")], 1), (k + 4, [1.0, None], 1), (k + 5, [], 1), (k + 6, [1.0, 2.0], 1), (k + 7, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "vec_id long, embedding array<float>, label int, id string, n int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    ok = {i: np.array(e, float) for i, e, label in rows if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    label = {i: x for i, _, x in rows}
    near = lambda a, b: len(a) == len(b) and a @ b / np.sqrt(a @ a * (b @ b)) >= 0.98
    links = {(i, j) for i in ok for j in ok if i < j and label[i] == label[j] and near(ok[i], ok[j])}
    n = {i: sum(i in p for p in links) for i in got}
    found, true = sum(got[i].n_links for i in ok), 2 * len(links)
    assert true * 0.98 <= found <= true and all(got[i].n_links <= n[i] for i in got)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in got if i not in ok and i is not None)
    assert all(r.kept == (i == r.component_id) for i, r in got.items() if i is not None) and got[None].component_id is None and not got[None].kept
    assert got[k + 7].component_id == k + 6
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    scratch = common.Scratch(spark, "test")
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.id: r.component for r in common.components(scratch, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[150] == got[200] == 100 and got[1299] == 1000
    assert common.components(scratch, spark.createDataFrame([], "a long, b long"), "none").count() == 0
