"""URL and domain functions, all Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme of an engine's own pages (home, help), unless another is named.
INTERNAL = "app"
#: Fixed values.
ABSOLUTE_SCHEMES = ["http://", "https://", "rss://", "dict://", "hn://"]
URL_ENDINGS = [".com", ".org", ".net", ".io", ".dev", ".co", ".me", ".app", ".edu", ".gov", ".uk", ".de", ".fr", ".jp", ".au", ".ca", ".info", ".biz", ".tv", ".cc", ".xyz", ".tech", ".ai"]
PREFIXES = [
    (["ddg", "duckduckgo"], "DuckDuckGo"),
    (["wp", "wiki", "wikipedia"], "Wikipedia"),
    (["gh", "github"], "GitHub"),
    (["hn", "hackernews"], "Hacker News"),
    (["go", "pkg"], "pkg.go.dev"),
    (["arch", "archwiki"], "Arch Wiki"),
    (["mdn"], "MDN Web Docs"),
    (["man", "manpages"], "Man Pages"),
    (["dict", "define", "d"], "Dictionary"),
    (["ai", "sum", "summary"], "AI Summary"),
]
PROVIDERS = {
    "duckduckgo": ["duckduckgo", "ddg", "DuckDuckGo"],
    "wikipedia": ["wikipedia", "wiki", "wp", "Wikipedia"],
    "github": ["github", "gh", "GitHub"],
    "hackernews": ["hackernews", "hn", "Hacker News"],
    "pkggodev": ["pkggodev", "go", "pkg.go.dev"],
    "archwiki": ["archwiki", "arch", "Arch Wiki"],
    "mdn": ["mdn", "MDN Web Docs"],
    "manpages": ["manpages", "man", "Man Pages"],
    "wiktionary": ["wiktionary", "dict", "Wiktionary"],
}


def domain(url: Column) -> Column:
    """Host part by string cutting, without www.; a relative url gives ''."""
    bare = F.substring_index(F.regexp_replace(url, r"^https?://", ""), "/", 1)
    return F.when(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")), F.regexp_replace(bare, r"^www\.", "")).otherwise(F.when(F.contains(url, F.lit("://")), F.regexp_replace(F.substring_index(F.regexp_replace(url, r"^.*?://", ""), "/", 1), r"^www\.", "")).otherwise(F.lit("")))


def host(url: Column) -> Column:
    """Authority without user info; '' where there is none."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")


def normal_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def without_hash(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def fragment(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("#")), F.regexp_extract(url, r"(?s)^[^#]*#(.*)$", 1)).otherwise(F.lit(""))


def same_page(a: Column, b: Column) -> Column:
    return without_hash(a) == without_hash(b)


def resolve(base: Column, href: Column, internal: str = INTERNAL) -> Column:
    """href seen from base: no dot segments are folded, a query counts as a relative path; internal is the scheme of own pages."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/]*)", 1)
    path = F.regexp_replace(base, r"(?s)^.*?://[^/]*", "")
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    plain = ~F.contains(base, F.lit("://"))
    absolute = F.lit(False)
    for scheme in [*ABSOLUTE_SCHEMES, f"{internal}://"]:
        absolute = absolute | F.startswith(href, F.lit(scheme))
    return (
        F.when(F.startswith(href, F.lit("#")), F.concat(without_hash(base), href))
        .when(absolute, href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.when(F.startswith(base, F.lit("https://")), "https:").otherwise("http:"), href))
        .when(F.startswith(href, F.lit("/")), F.when(plain, href).otherwise(F.concat(origin, href)))
        .when(plain | (path == ""), F.concat(base, F.lit("/"), href))
        .otherwise(F.concat(origin, folder, href))
    )


def optimise_google(url: Column, language: str = "en") -> Column:
    """A Google search URL with plain-page parameters set and its query in order of names."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fixed = {"gbv": "1", "gl": "us", "hl": language, "pws": "0"}
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*fixed))
    every = F.array_sort(F.concat(pairs, F.array(*[F.lit(f"{k}={v}") for k, v in fixed.items()])))
    return F.concat(F.substring_index(without_hash(url), "?", 1), F.lit("?"), F.array_join(every, "&"))


def query_value(url: Column, name: str) -> Column:
    """Decoded value of a query parameter; null if it is not there or not decodable."""
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def google_to_duckduckgo(url: Column) -> Column:
    q = query_value(url, "q")
    return F.when(q.isNull(), url).otherwise(F.concat(F.lit("https://html.duckduckgo.com/html/?q="), F.url_encode(q)))


def unwrap_duckduckgo(href: Column) -> Column:
    """The address that a redirect link wraps, else the link; a scheme-less one gets https."""
    return F.coalesce(query_value(href, "uddg"), F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href))


def file_name(url: Column) -> Column:
    """Last path segment without query, fragment and extension."""
    last = F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), "/", -1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def shorten(url: Column, most: int) -> Column:
    """A middle ellipsis where the URL is longer than most."""
    half = (most - 3) // 2
    cut = F.left(url, F.lit(most)) if most < 10 else F.concat(F.left(url, F.lit(half)), F.lit("..."), F.right(url, F.lit(half)))
    return F.when(F.length(url) <= most, url).otherwise(cut)


def content_type_of(url: Column) -> Column:
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""))
    return (
        F.when(path.rlike("/article|/post|/blog"), "Article")
        .when(path.rlike("/video|/watch"), "Video")
        .when(path.rlike("/doc"), "Documentation")
        .when(path.rlike(r"\.pdf$"), "PDF")
        .when(path.rlike(r"\.(png|jpg|gif)$"), "Image")
        .otherwise("")
    )


def page_type_of(url: Column) -> Column:
    u = F.lower(url)
    deep = F.length(u) - F.length(F.replace(u, F.lit("/"))) > 4
    article = u.rlike("/article|/story/|/post/") | (u.rlike("/news/|/blog/") & deep)
    return F.when(article, "article").when(u.rlike(r"search|\?q=|\?query="), "search").when(u.rlike("/category/|/tag/|/topics/"), "listing").otherwise("home")


def looks_like_url(text: Column) -> Column:
    low = F.lower(text)
    ending = F.lit(False)
    for e in URL_ENDINGS:
        ending = ending | F.contains(low, F.lit(e))
    return ~F.contains(text, F.lit(" ")) & (ending | low.rlike(r"^localhost|^127\."))


def is_image(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(jpg|jpeg|png|gif|webp|bmp|svg|ico)($|\?)")


def is_hn(url: Column) -> Column:
    return F.contains(url, F.lit("news.ycombinator.com"))


def is_hn_comments(url: Column) -> Column:
    return is_hn(url) & F.contains(url, F.lit("item?id="))


def is_google_search(url: Column) -> Column:
    return F.lower(host(url)).rlike(r"(^|\.)google\.[a-z.]+$") & F.regexp_replace(url, r"^[a-z]+://[^/?#]*", "").rlike(r"^/search")


def is_duckduckgo_search(url: Column) -> Column:
    return F.contains(F.lower(host(url)), F.lit("duckduckgo.com"))


def provider(name: Column) -> Column:
    """Search provider of a name or alias; unknown ones mean DuckDuckGo."""
    out = None
    for canonical, names in PROVIDERS.items():
        out = F.when(name.isin(*names), canonical) if out is None else out.when(name.isin(*names), canonical)
    return out.otherwise("duckduckgo")


def form_url(action: Column, names: list[Column], values: list[Column]) -> Column:
    """The address that a form submits to."""
    pairs = [F.concat(n, F.lit("="), F.url_encode(v)) for n, v in zip(names, values, strict=True)]
    return F.concat(action, F.when(F.contains(action, F.lit("?")), "&").otherwise("?"), F.concat_ws("&", *pairs)) if pairs else action


def omnibox(text: Column, prefixes: list[tuple[list[str], str]] | None = None, external: dict[str, str] | None = None, internal: str = INTERNAL) -> Column:
    """What an input means, as a struct. Commands come first, then explicit schemes, summaries, dictionary
    look-ups, provider prefixes (by space, then by colon), addresses, and search at last. external maps
    further prefixes to address formats with %s, internal is the scheme of own pages."""
    fields = ["url", "query", "is_search", "use_internal", "provider", "is_ai_summary", "ai_prompt", "is_dict_lookup", "dict_word"]
    flags = {"is_search", "use_internal", "is_ai_summary", "is_dict_lookup"}

    def result(**given) -> Column:
        return F.struct(*[(given[f] if isinstance(given.get(f), Column) else F.lit(given.get(f, False if f in flags else ""))).alias(f) for f in fields])

    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    low = F.lower(t)
    after = lambda pattern: F.regexp_replace(F.regexp_replace(t, pattern, ""), r"^\s+|\s+$", "")
    ai = r"(?i)^(ai|sum|summary)[ :]"
    out = (
        F.when(t == "", result())
        .when(low.isin("?", "help"), result(url=f"{internal}://help"))
        .when(low == "home", result(url=f"{internal}://home"))
        .when(low.isin("rss", "feeds", "feed"), result(url="rss://"))
        .when(F.contains(t, F.lit("://")), result(url=t))
        .when(low.isin("sum", "ai", "summary"), result(is_ai_summary=True, provider="AI Summary"))
        .when(t.rlike(ai), result(is_ai_summary=True, ai_prompt=after(ai), provider="AI Summary"))
    )
    for sep in (" ", ":"):
        word = rf"(?i)^(dict|define|d){sep}"
        out = out.when(t.rlike(word) & (after(word) != ""), result(is_dict_lookup=True, dict_word=after(word), provider="Dictionary"))
    for sep in (" ", ":"):
        head = F.lower(F.regexp_replace(F.substring_index(t, sep, 1), r"^\s+|\s+$", ""))
        query = after(rf"(?s)^[^{sep}]*{sep}")
        there = F.contains(t, F.lit(sep)) & (query != "")
        for names, shown in prefixes or PREFIXES:
            out = out.when(there & head.isin(*names), result(query=query, is_search=True, use_internal=True, provider=shown))
        for name, form in (external or {}).items():
            before, _, rest = form.partition("%s")
            out = out.when(there & (head == name), result(url=F.concat(F.lit(before), F.url_encode(query), F.lit(rest)), is_search=True, provider=name))
    return out.when(looks_like_url(t), result(url=F.concat(F.lit("https://"), t))).otherwise(result(query=t, is_search=True, use_internal=True, provider="Search"))
