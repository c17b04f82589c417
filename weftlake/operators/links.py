"""Link tables: clean-up rules, blocked pages, keep-first dedup, queue upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: What makes a linked host worthless.
BAD_STARTS = ["+", "tel:", "!", "$", "(", '"', ".", "-", ",", "*", "#", "@", "?", "/", "\\", "{", "["]
SPAM_HOSTS = ["%.51dzw.com", "%.sxwmcc.com", "%.9856.cn", "%.hotic.51dzw.com"]
BLOG_HOSTS = ["%.livejournal.com", "%.dreamwidth.org", "%.insanejournal.com", "%.greatestjournal.com", "%.tumblr.com", "%.blogspot.com", "%.blogspot.%", "%.wordpress.com", "%.createblog.com", "%.beeplog.%"]
DOWNLOAD_HOSTS = ["%.softonic.%", "%.uptodown.%", "%.informer.com"]
OTHER_HOSTS = ["%.sikatika.com", "%.qowap.com", "%.listal.com", "%.mykajabi.com", "%.stck.me", "%.izrablog.com", "%.blogsidea.com", "%.blogmazing.com", "%.jsyinshanfu.com", "%.oh-hotel.%", "%.life3dblog.com"]
SOCIAL = [
    "facebook.com", "www.facebook.com", "web.facebook.com", "m.facebook.com", "twitter.com", "www.twitter.com", "mobile.twitter.com", "x.com", "www.x.com", "instagram.com", "www.instagram.com", "linkedin.com",
    "www.linkedin.com", "youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "tiktok.com", "www.tiktok.com", "pinterest.com", "www.pinterest.com", "reddit.com", "www.reddit.com", "old.reddit.com",
    "discord.com", "discord.gg", "telegram.org", "t.me", "whatsapp.com", "api.whatsapp.com", "wa.me", "snapchat.com", "twitch.tv", "www.twitch.tv",
]
BIG_HOSTS = ["%.google.%", "%.googleapis.com", "%.gstatic.com", "%.apple.com", "%.microsoft.com", "%.amazon.%", "%.amazonaws.com", "%.cloudfront.net"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "j.mp", "lnkd.in", "db.tt", "qr.ae", "adf.ly", "cur.lv", "ity.im", "q.gs", "po.st", "bc.vc", "su.pr"]
SPAM_ENDINGS = [".click", ".loan", ".work", ".gq", ".ml", ".cf", ".tk", ".ga", ".pw"]


def _split(patterns: list[str]) -> tuple[list[str], list[str]]:
    """Domains of patterns %.domain, and labels of patterns %.label.%."""
    return [p[2:] for p in patterns if not p.endswith(".%")], [p[2:-2] for p in patterns if p.endswith(".%")]


def _suffix_rule(labels: Column, patterns: list[str]) -> Column:
    """Whether a host lies below one of the domains, or has one of the labels between others: a look-up in a set for each of the host's suffixes, of its inner labels for the few patterns with an open end."""
    domains, inner = _split(patterns)
    n = F.size(labels)
    out = F.lit(False)
    if domains:
        most = max(d.count(".") for d in domains) + 1
        suffixes = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(k < n, F.array_join(F.slice(labels, n - k + 1, k), ".")))
        out = out | F.coalesce(F.exists(suffixes, lambda x: x.isin(*domains)), F.lit(False))
    if inner:
        out = out | F.exists(F.slice(labels, 2, F.greatest(n - 2, F.lit(0))), lambda x: x.isin(*inner))
    return out


def link_rules(domain: Column) -> dict[str, Column]:
    """Each clean-up rule as a condition; a null domain breaks none. Rules on hosts go by the labels of the lower-case host, so their number does not matter."""
    low = F.lower(domain)
    labels = F.split(low, r"\.")
    starts = F.lit(False)
    for s in BAD_STARTS:
        starts = starts | F.startswith(low, F.lit(s))
    last, n = F.element_at(labels, -1), F.length(domain)
    below = F.size(labels) > 1
    desktop = _suffix_rule(labels, ["%.desktop.%"])
    return {
        "start": starts,
        "no_dot": ~F.contains(domain, F.lit(".")),
        "size": (n < 4) | (n > 80),
        "spam": _suffix_rule(labels, SPAM_HOSTS),
        "blog": _suffix_rule(labels, BLOG_HOSTS),
        "download": _suffix_rule(labels, DOWNLOAD_HOSTS),
        "other": _suffix_rule(labels, OTHER_HOSTS),
        "social": domain.isin(*SOCIAL),
        "big": _suffix_rule(labels, BIG_HOSTS),
        "shortener": domain.isin(*SHORTENERS),
        "ending": below & (last.isin(*[e[1:] for e in SPAM_ENDINGS]) | ((last == "top") & ~desktop) | ((last == "xyz") & (n > 20))),
        "not_ascii": domain.rlike(r"[^ -~]"),
    }


def is_bad_link(domain: Column) -> Column:
    bad = F.lit(False)
    for c in link_rules(domain).values():
        bad = bad | c
    return F.coalesce(bad, F.lit(False))


def clean_links(links: DataFrame, column: str = "to_domain") -> DataFrame:
    return links.where(~is_bad_link(F.col(column)))


def clean_up_report(links: DataFrame, column: str = "to_domain") -> DataFrame:
    """One row: links before and after, and how many each rule hits. Every rule is evaluated once for each link."""
    rules = link_rules(F.col(column))
    hit = links.select(*[F.coalesce(r, F.lit(False)).alias(f"by_{name}") for name, r in rules.items()])
    bad = F.lit(False)
    for name in rules:
        bad = bad | F.col(f"by_{name}")
    return hit.agg(F.count("*").alias("before"), F.count_if(~bad).alias("after"), *[F.count_if(f"by_{name}").alias(f"by_{name}") for name in rules])


def blocked_reason(html: Column) -> Column:
    """Why a page is a challenge rather than content; '' if it is not."""
    has = lambda s: F.contains(html, F.lit(s))
    small = lambda n: F.octet_length(html) < n
    return (
        F.when(has("unusual traffic from your computer") | has("detected unusual traffic"), "Google CAPTCHA")
        .when(has("recaptcha") & small(10000), "reCAPTCHA challenge")
        .when(has("Just a moment...") | has("Checking your browser") | has("cf-browser-verification"), "Cloudflare challenge")
        .when(has("Before you continue") & has("consent.google"), "Google consent page")
        .when(has("captcha-delivery.com") | has("DataDome"), "DataDome bot protection")
        .when(has("akam/") & small(5000), "Akamai bot protection")
        .when(has("perimeterx") | has("px-captcha"), "PerimeterX bot protection")
        .otherwise("")
    )


def is_bot_page(html: Column) -> Column:
    """A small page that asks to prove one is human."""
    marks = ["captcha-delivery.com", "Please enable JS and disable any ad blocker", "cf-browser-verification", "Checking your browser", "bot-check", "human-verification"]
    any_ = F.lit(False)
    for m in marks:
        any_ = any_ | F.contains(html, F.lit(m))
    return (F.octet_length(html) <= 50000) & any_


def accepted(html: Column) -> Column:
    """Whether a plain fetch is good enough not to need a browser."""
    return (blocked_reason(html) == "") & (F.octet_length(html) > 5000)


def first_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the order given."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def enqueue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue with urls that it lacks; of repeated ones the first by priority, depth and source."""
    new = first_by(found, ["url"], "priority", "depth", "found_from").join(queue.select("url"), "url", "left_anti")
    return queue.unionByName(new.select(*queue.columns))


def mark_done(done: DataFrame, topics: DataFrame) -> DataFrame:
    """Completed topics, a new completion replacing an old one."""
    return done.join(topics.select("topic"), "topic", "left_anti").unionByName(topics.select(*done.columns))


def open_topics(topics: DataFrame, done: DataFrame, seed: int = 0) -> DataFrame:
    """Topics not completed, in a shuffled order that the seed fixes."""
    return topics.join(done.select("topic"), "topic", "left_anti").orderBy(F.xxhash64("topic", F.lit(seed)), "topic")


def with_scores(links: DataFrame, scores: DataFrame, column: str = "domain") -> DataFrame:
    """Links with the mark of their domain's score: ★ from 95, ✓ from 80. scores(domain, score) is reference data of known size; its join is left to the optimiser."""
    key = F.regexp_replace(F.lower(column), r"^www\.", "")
    s = scores.select(F.lower("domain").alias("__domain"), "score")
    mark = F.when(F.col("score") >= 95, "★").when(F.col("score") >= 80, "✓").otherwise("")
    return links.withColumn("__key", key).join(s, F.col("__key") == F.col("__domain"), "left").withColumn("mark", mark).drop("__key", "__domain")


def theme_colour(candidates: Column) -> Column:
    """The first usable of a page's tile, background and theme colours."""
    from weftlake.functions.values import normal_colour, usable_accent

    fine = F.filter(F.transform(candidates, normal_colour), lambda c: (c != "") & usable_accent(c))
    return F.coalesce(F.try_element_at(fine, F.lit(1)), F.lit(""))


def meta_tags(pages: DataFrame) -> DataFrame:
    """(page_id, title, description, site_name, content_type) from the first 16 KiB of each page, without a parse."""
    from weftlake.functions.text import collapse, decode_entities, first_non_empty, byte_prefix
    from weftlake.functions.urls import content_type_of

    head = byte_prefix(F.col("html"), 16384)

    def meta(name: str) -> Column:
        attr = rf"(?:property|name)\s*=\s*[\"']{name}[\"']"
        a = F.regexp_extract("__head", rf"(?is)<meta\b[^>]*?{attr}[^>]*?\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
        b = F.regexp_extract("__head", rf"(?is)<meta\b[^>]*?\bcontent\s*=\s*\"([^\"]*)\"[^>]*?{attr}", 1)
        return decode_entities(F.when(a != "", a).otherwise(b))

    title = collapse(decode_entities(F.regexp_extract("__head", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    text = first_non_empty(meta("og:description"), meta("twitter:description"), meta("description"))
    short = F.when(F.octet_length(text) > 200, F.concat(byte_prefix(text, 200), F.lit("..."))).otherwise(text)
    kind = F.lower(meta("og:type"))
    shown = F.when(kind == "", content_type_of(F.col("url"))).when(kind.isin("video", "video.other"), "Video").when(kind.isin("music.song", "music.album"), "Music").otherwise(F.initcap(F.replace(kind, F.lit("."), F.lit(" "))))
    return pages.withColumn("__head", head).select("page_id", first_non_empty(meta("og:title"), meta("twitter:title"), title).alias("title"), short.alias("description"), meta("og:site_name").alias("site_name"), shown.alias("content_type"))


def harvest_hosts(bodies: DataFrame, key: str = "topic", body: str = "html", most: int = 30, skip: tuple[str, ...] = ("google.", "facebook.", "twitter.", "youtube.", "duckduckgo.", "amazon.", "instagram.", "linkedin.")) -> DataFrame:
    """(key, ord, url): hosts of result links of a search page, distinct, the first `most`."""
    found = bodies.select(key, F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r'uddg=([^&"]+)'), F.lit(1))).alias("ord", "raw"))
    host = F.lower(F.regexp_extract(F.try_url_decode("raw"), r"^https?://([^/?#]+)", 1))
    found = found.select(key, "ord", host.alias("host")).where(F.col("host") != "")
    for s in skip:
        found = found.where(~F.contains("host", F.lit(s)))
    found = first_by(found, [key, "host"], "ord")
    w = W.Window.partitionBy(key).orderBy("ord")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(key, (F.col("n") - 1).alias("ord"), F.concat(F.lit("https://"), "host").alias("url"))
