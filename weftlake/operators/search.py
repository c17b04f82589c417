"""Search results: parsers of result pages and JSON answers into one schema, link previews, dictionary entries, result pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftlake.functions import css
from weftlake.functions.dom import Node, ancestors, children, following, text_of
from weftlake.functions.text import escape, first_non_empty, format_count, strip_tags
from weftlake.functions.urls import host, unwrap_duckduckgo
from weftlake.operators.content import nbytes, page_parts

_RESULT = "array<struct<title:string,url:string,snippet:string>>"


def _link(nodes: list[Node], i: int | None) -> tuple[str, str]:
    return ("", "") if i is None else (text_of(nodes, i), nodes[i].attrs.get("href", ""))


def _one(nodes: list[Node], selector: str, scope: int) -> int | None:
    return next(css.found(nodes, selector, scope), None)


def duckduckgo(nodes: list[Node]) -> list[dict]:
    out = []
    for i in css.select(nodes, "div.result, div.results_links"):
        title, href = _link(nodes, _one(nodes, "a.result__a", i))
        s = _one(nodes, ".result__snippet", i)
        if title and href:
            out.append({"title": title, "url": href, "snippet": text_of(nodes, s) if s is not None else ""})
    return out


def mediawiki(nodes: list[Node]) -> list[dict]:
    out = []
    for i in css.select(nodes, "li.mw-search-result, li.mw-search-result-ns-0"):
        a = _one(nodes, ".mw-search-result-heading a", i)
        title, href = _link(nodes, a if a is not None else _one(nodes, "a", i))
        s = _one(nodes, ".searchresult", i)
        if title and href:
            out.append({"title": title, "url": href, "snippet": text_of(nodes, s) if s is not None else ""})
    return out


def first_definition(nodes: list[Node]) -> str:
    """The first list item of an ordered list of a usable size."""
    return next((t for t in (text_of(nodes, i) for i in css.select(nodes, "ol > li")) if 10 < nbytes(t) < 500), "")


def man_pages(nodes: list[Node]) -> list[dict]:
    out = []
    for i in css.select(nodes, "tr, li, dt"):
        title, href = _link(nodes, _one(nodes, "a", i))
        if not title or "/man" not in href:
            continue
        if nodes[i].tag == "dt":
            after = [j for j in children(nodes, nodes[i].parent) if j > i and nodes[j].tag[0] != "#"]
            rest = text_of(nodes, after[0]) if after and nodes[after[0]].tag == "dd" else ""
        else:
            rest = text_of(nodes, i).removeprefix(title).strip(" -–—")
        out.append({"title": title, "url": href, "snippet": rest})
    if not out:
        seen: dict[str, dict] = {}
        for i in css.select(nodes, 'a[href*="/man/"]'):
            title, href = _link(nodes, i)
            if title:
                seen.setdefault(href, {"title": title, "url": href, "snippet": ""})
        out = list(seen.values())
    return out


def go_packages(nodes: list[Node]) -> list[dict]:
    out = []
    for i in css.select(nodes, ".SearchSnippet"):
        title, href = _link(nodes, _one(nodes, "h2 a, a", i))
        s = _one(nodes, ".SearchSnippet-synopsis", i)
        if title:
            out.append({"title": title, "url": href, "snippet": text_of(nodes, s) if s is not None else ""})
    if not out:
        seen: dict[str, dict] = {}
        for i in css.select(nodes, 'a[data-gtmc="search result"]'):
            title, href = _link(nodes, i)
            box = next((j for j in ancestors(nodes, i) if "snippet" in nodes[j].attrs.get("class", "").lower()), None)
            s = _one(nodes, "[class*=synopsis]", box) if box is not None else None
            seen.setdefault(href, {"title": title, "url": href, "snippet": text_of(nodes, s) if s is not None else ""})
        out = list(seen.values())
    return out


#: Parsers of result pages and where their relative links belong.
PAGES = {
    "duckduckgo": (duckduckgo, ""),
    "archwiki": (mediawiki, "https://wiki.archlinux.org"),
    "wiktionary": (mediawiki, "https://en.wiktionary.org"),
    "manpages": (man_pages, "https://man.archlinux.org"),
    "pkggodev": (go_packages, "https://pkg.go.dev"),
}


def html_results(pages: DataFrame, provider: str) -> DataFrame:
    """(query, provider, rank, title, url, snippet, domain) of pages(query, html), repeated urls kept once."""
    parse, base = PAGES[provider]
    rows = page_parts(pages, ["results"], keep=["query"], more={"results": (parse, _RESULT)}).select("query", F.posexplode("results").alias("ord", "r")).select("query", "ord", "r.*")
    url = F.when(F.startswith("url", F.lit("/")) & ~F.startswith("url", F.lit("//")), F.concat(F.lit(base), "url")).otherwise(F.col("url"))
    rows = rows.withColumn("url", unwrap_duckduckgo(url) if provider == "duckduckgo" else url)
    return _ranked(rows, provider)


def _ranked(rows: DataFrame, provider: str) -> DataFrame:
    first = W.Window.partitionBy("query", "url").orderBy("ord")
    order = W.Window.partitionBy("query").orderBy("ord")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("query", F.lit(provider).alias("provider"), F.row_number().over(order).alias("rank"), "title", "url", "snippet", F.regexp_replace(host(F.col("url")), r"^www\.", "").alias("domain"))


def json_results(answers: DataFrame, provider: str) -> DataFrame:
    """The same of answers(query, body) of the wikipedia, github, hackernews and mdn interfaces."""
    none = F.lit("")
    text = lambda c: F.coalesce(c, none)
    if provider == "wikipedia":
        schema, items, most = "query struct<search:array<struct<title:string,snippet:string>>>", "a.query.search", 15
        made = lambda x: F.struct(x["title"].alias("title"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(x["title"], F.lit(" "), F.lit("_"))).alias("url"), strip_tags(text(x["snippet"])).alias("snippet"))
    elif provider == "github":
        schema, items, most = "items array<struct<full_name:string,html_url:string,description:string,stargazers_count:bigint,forks_count:bigint,language:string>>", "a.items", 25
        made = lambda x: F.struct(
            x["full_name"].alias("title"), x["html_url"].alias("url"),
            F.concat_ws(" · ", F.nullif(text(x["description"]), none), F.concat(F.lit("★ "), format_count(F.coalesce(x["stargazers_count"], F.lit(0)))), F.when(x["forks_count"] > 0, F.concat(format_count(x["forks_count"]), F.lit(" forks"))), F.nullif(text(x["language"]), none)).alias("snippet"),
        )
    elif provider == "hackernews":
        schema, items, most = "hits array<struct<objectID:string,title:string,url:string,points:bigint,num_comments:bigint,author:string>>", "a.hits", 25
        made = lambda x: F.struct(
            text(x["title"]).alias("title"), first_non_empty(x["url"], F.concat(F.lit("https://news.ycombinator.com/item?id="), x["objectID"])).alias("url"),
            F.concat(F.coalesce(x["points"], F.lit(0)).cast("string"), F.lit(" points · "), F.coalesce(x["num_comments"], F.lit(0)).cast("string"), F.lit(" comments · by "), text(x["author"])).alias("snippet"),
        )
    else:
        schema, items, most = "documents array<struct<title:string,mdn_url:string,summary:string>>", "a.documents", 25
        made = lambda x: F.struct(x["title"].alias("title"), F.concat(F.lit("https://developer.mozilla.org"), text(x["mdn_url"])).alias("url"), text(x["summary"]).alias("snippet"))
    rows = answers.select("query", F.from_json("body", schema).alias("a")).select("query", F.posexplode(F.slice(F.transform(items, made), 1, most)).alias("ord", "r"))
    return _ranked(rows.select("query", "ord", "r.*").where("title <> ''"), provider)


def results_page(results: DataFrame) -> DataFrame:
    """(query, html): each query's results as one page."""
    item = F.concat(F.lit("<h2>"), F.col("rank").cast("string"), F.lit('. <a href="'), escape(F.col("url")), F.lit('">'), escape(F.col("title")), F.lit("</a></h2><p>"), escape(F.col("domain")), F.lit("</p><p>"), escape(F.col("snippet")), F.lit("</p>"))
    rows = results.groupBy("query", "provider").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"))
    head = F.concat(F.lit("<h1>"), escape(F.col("query")), F.lit("</h1><p>"), F.size("items").cast("string"), F.lit(" results from "), F.col("provider"), F.lit("</p>"))
    return rows.select("query", F.concat(head, F.array_join(F.transform("items", lambda x: x["item"]), "")).alias("html"))


def dictionary(answers: DataFrame) -> DataFrame:
    """(word, phonetic, meaning_ord, part_of_speech, definition_ord, definition, example) of dictionary answers (word, body)."""
    schema = "array<struct<word:string,phonetic:string,meanings:array<struct<partOfSpeech:string,definitions:array<struct<definition:string,example:string>>>>>>"
    rows = answers.select("word", F.from_json("body", schema).alias("e")).select("word", F.explode("e").alias("e"))
    rows = rows.select("word", F.coalesce("e.phonetic", F.lit("")).alias("phonetic"), F.posexplode("e.meanings").alias("meaning_ord", "m"))
    rows = rows.select("word", "phonetic", "meaning_ord", F.col("m.partOfSpeech").alias("part_of_speech"), F.posexplode("m.definitions").alias("definition_ord", "d"))
    return rows.select("word", "phonetic", "meaning_ord", "part_of_speech", "definition_ord", "d.definition", F.coalesce("d.example", F.lit("")).alias("example"))


def preview(answers: DataFrame) -> DataFrame:
    """(url, title, description, site_name) of JSON answers(url, body), read by what the url's host answers with."""
    h = F.regexp_replace(F.lower(host(F.col("url"))), r"^www\.", "")
    github = F.from_json("body", "full_name string, description string, stargazers_count bigint, language string")
    hn = F.from_json("body", "title string, score bigint, descendants bigint, by string")
    video = F.from_json("body", "title string, author_name string")
    wiki = F.from_json("body", "title string, extract string")
    reddit = F.get(F.from_json("body", "array<struct<data:struct<children:array<struct<data:struct<title:string,selftext:string,score:bigint,num_comments:bigint,subreddit:string>>>>>>")["data"], 0)["children"]
    post = F.get(reddit, 0)["data"]
    none = F.lit("")

    def by_host(pairs: list[tuple[str, Column]]) -> Column:
        out = None
        for pattern, c in pairs:
            out = F.when(h.rlike(pattern), c) if out is None else out.when(h.rlike(pattern), c)
        return F.coalesce(out, none)

    hosts = {"github": r"^github\.com$", "hn": r"^news\.ycombinator\.com$", "reddit": r"(^|\.)reddit\.com$", "video": r"^(youtube\.com|m\.youtube\.com|youtu\.be)$", "wiki": r"\.wikipedia\.org$"}
    points = lambda n, c: F.concat(F.coalesce(n, F.lit(0)).cast("string"), F.lit(" points · "), F.coalesce(c, F.lit(0)).cast("string"), F.lit(" comments"))
    return answers.select(
        "url",
        by_host([(hosts["github"], github["full_name"]), (hosts["hn"], hn["title"]), (hosts["reddit"], post["title"]), (hosts["video"], video["title"]), (hosts["wiki"], wiki["title"])]).alias("title"),
        by_host([(hosts["github"], github["description"]), (hosts["hn"], points(hn["score"], hn["descendants"])), (hosts["reddit"], first_non_empty(post["selftext"], points(post["score"], post["num_comments"]))), (hosts["video"], video["author_name"]), (hosts["wiki"], wiki["extract"])]).alias("description"),
        by_host([(hosts["github"], F.lit("GitHub")), (hosts["hn"], F.lit("Hacker News")), (hosts["reddit"], F.lit("Reddit")), (hosts["video"], F.lit("YouTube")), (hosts["wiki"], F.lit("Wikipedia"))]).alias("site_name"),
    )


def preview_any(answers: DataFrame) -> DataFrame:
    """The same for every host: where none of the interfaces answers, the tags of the first 16 KiB of the page itself."""
    from weftlake.operators.links import meta_tags

    known = F.regexp_replace(F.lower(host(F.col("url"))), r"^www\.", "").rlike(r"^github\.com$|^news\.ycombinator\.com$|(^|\.)reddit\.com$|^(youtube\.com|m\.youtube\.com|youtu\.be)$|\.wikipedia\.org$")
    pages = answers.where(~F.coalesce(known, F.lit(False))).select(F.col("url").alias("page_id"), "url", F.col("body").alias("html"))
    return preview(answers.where(known)).unionByName(meta_tags(pages).select(F.col("page_id").alias("url"), "title", "description", "site_name"))


# ---- discussion pages ----------------------------------------------------------------------------

_NUMBER = re.compile(r"\d+")


def discussion_comments(nodes: list[Node]) -> list[dict]:
    """Comments of a discussion page: id, author, age, indent, text, deleted."""
    out = []
    for i in css.select(nodes, "tr.comtr"):
        ind = _one(nodes, "td.ind", i)
        image = _one(nodes, "img", ind) if ind is not None else None
        level = int(nodes[ind].attrs["indent"]) if ind is not None and nodes[ind].attrs.get("indent", "").isdigit() else int(nodes[image].attrs.get("width") or 0) // 40 if image is not None else 0
        body, user, age = _one(nodes, ".commtext", i), _one(nodes, "a.hnuser", i), _one(nodes, ".age", i)
        out.append({
            "ord": len(out), "id": nodes[i].attrs.get("id", ""), "author": text_of(nodes, user) if user is not None else "", "age": text_of(nodes, age) if age is not None else "",
            "indent": level, "text": _marked(nodes, body) if body is not None else "", "deleted": body is None,
        })
    return out


def _marked(nodes: list[Node], i: int) -> str:
    """Text with _emphasis_, `code`, links as text [address], and blank lines between paragraphs."""
    out: list[str] = []

    def walk(k: int) -> None:
        for j in children(nodes, k):
            n = nodes[j]
            if n.tag == "#text":
                out.append(n.text)
            elif n.tag == "p":
                out.append("\n\n")
                walk(j)
            elif n.tag == "i":
                out.append(f"_{text_of(nodes, j)}_")
            elif n.tag in ("code", "pre"):
                out.append(f"`{text_of(nodes, j)}`")
            elif n.tag == "a":
                t, href = text_of(nodes, j), n.attrs.get("href", "")
                out.append(t if t == href or not href else f"{t} [{href}]")
            elif n.tag != "#comment" and "reply" not in n.classes():
                walk(j)

    walk(i)
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", p).strip() for p in "".join(out).split("\n\n")) if x)


def discussion_stories(nodes: list[Node], base: str = "https://news.ycombinator.com/") -> list[dict]:
    """Stories of a front page, each with the figures of the row after it."""
    out = []
    for i in css.select(nodes, "tr.athing"):
        if "comtr" in nodes[i].classes():
            continue
        title, href = _link(nodes, _one(nodes, ".titleline > a, a.storylink, td.title > a", i))
        if not title:
            continue
        rank, site = _one(nodes, ".rank", i), _one(nodes, ".sitestr", i)
        row = next((j for j in following(nodes, i) if nodes[j].tag == "tr"), None)
        get = lambda s: "" if row is None or (j := _one(nodes, s, row)) is None else text_of(nodes, j)  # noqa: E731, B023
        number = lambda s: int(m[0]) if (m := _NUMBER.search(s)) else 0
        comments = next((t for t in (text_of(nodes, a) for a in css.found(nodes, "a", row)) if "comment" in t), "") if row is not None else ""
        out.append({
            "ord": len(out), "rank": number(text_of(nodes, rank)) if rank is not None else 0, "title": title, "href": base + href if href.startswith("item?") else href, "site": text_of(nodes, site) if site is not None else "",
            "points": number(get(".score")), "author": get("a.hnuser"), "age": get(".age"), "comments": number(comments),
        })
    return out


def comments_of(pages: DataFrame) -> DataFrame:
    """(page_id, ord, id, author, age, indent, text, deleted, parent): parent is the last earlier comment that is indented less."""
    kind = "array<struct<ord:int,id:string,author:string,age:string,indent:int,text:string,deleted:boolean,parent:string>>"
    rows = page_parts(pages, ["comments"], more={"comments": (lambda nodes: with_parents(discussion_comments(nodes)), kind)})
    return rows.select("page_id", F.inline("comments"))


def with_parents(comments: list[dict]) -> list[dict]:
    """Comments with the id of their parent, in one pass: those that later ones may answer stand on a stack of rising indents."""
    open_: list[dict] = []
    out = []
    for c in comments:
        while open_ and open_[-1]["indent"] >= c["indent"]:
            open_.pop()
        out.append(c | {"parent": open_[-1]["id"] if open_ else None})
        open_.append(c)
    return out


def stories_of(pages: DataFrame) -> DataFrame:
    kind = "array<struct<ord:int,rank:int,title:string,href:string,site:string,points:int,author:string,age:string,comments:int>>"
    return page_parts(pages, ["stories"], more={"stories": (discussion_stories, kind)}).select("page_id", F.inline("stories"))
