"""Queries over feeds, search answers and discussion pages, which are first written out from the rows of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions.text import escape
from weftlake.operators import content, handlers, links, reading, search
from weftlake.plans.registry import COLLAPSED, PARAGRAPHS, QUERIES, SQL, query, table
from weftlake.sources import archive, documents, files
from weftlake.sources import feeds as sources
from weftlake.sources.keyed import KeyedStore
from weftlake.sources.state import shared_folder
from weftlake.streaming import feeds as stream
from weftlake.streaming import marks


__all__ = ["QUERIES", "SQL"]


def _joined(rows: DataFrame, key: Column, order: Column, piece: Column, before: str, after: str) -> DataFrame:
    """(key, body): the pieces of each key in order, between two fixed texts. Keys are users or conversations, so a body is small."""
    own = rows.select(key.alias("key"), F.struct(order.alias("o"), piece.alias("p")).alias("s")).groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return own.select("key", F.concat(F.lit(before), F.array_join(F.transform("s", lambda x: x["p"]), ""), F.lit(after)).alias("body"))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _feeds(spark: SparkSession, sf_dir: str, piece: Column, before: str, after: str) -> DataFrame:
    return _joined(table(spark, sf_dir, "events"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id"), piece, before, after).withColumnRenamed("key", "feed_url")


_LINK = "https://e.com/"
#: Events of which a page of a captured feed has those of its kind.
_PAGE = 5000
#: Files of a batch of polls: more than a part is written to.
_FILES = 100_000
_ORD = "(row_number() over (partition by user_id order by event_id) - 1)::int as ord"


def _text_id() -> Column:
    return F.col("event_id").cast("string")


# ---- feeds ---------------------------------------------------------------------------------------


@query(f"""select 'u' || user_id as feed_url, {_ORD}, event_id::varchar as guid, event_type || ' < more' as title, '{_LINK}' || event_id as link, 'by two' as description, date_trunc('second', ts) as published from events""")
def feed_rss(spark, sf_dir):
    when = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    piece = _cat("<item><title>", F.col("event_type"), "  &amp;lt; more</title><link>", _LINK, _text_id(), "</link><guid>", _text_id(), "</guid><description>by\n two</description><pubDate>", when, " +0000</pubDate></item>")
    bodies = _feeds(spark, sf_dir, piece, '<?xml version="1.0"?><rss version="2.0"><channel><title>T</title>', "</channel></rss>")
    return sources.feed_items(sources.parse_feeds(bodies)).select("feed_url", "ord", "guid", "title", "link", "description", "published")


@query(f"""select 'u' || user_id as feed_url, {_ORD}, case when event_id % 2 = 0 then 'tag:' || event_id else left(sha256('{_LINK}' || event_id), 16) end as guid, event_type as title, '{_LINK}' || event_id as link, '<p>' || event_type || '</p>' as content, 'who' as author,
  date_trunc('second', ts) as published from events""")
def feed_atom(spark, sf_dir):
    when = _cat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "Z")
    ident = F.when(F.col("event_id") % 2 == 0, _cat("<id>tag:", _text_id(), "</id>")).otherwise("")
    dated = F.when(F.col("event_id") % 3 == 0, _cat("<published>", when, "</published><updated>2001-01-01T00:00:00Z</updated>")).otherwise(_cat("<updated>", when, "</updated>"))
    piece = _cat("<entry>", ident, "<title>", F.col("event_type"), '</title><link rel="self" href="https://no.com"/><link rel="alternate" href="', _LINK, _text_id(), '"/><content type="html">&lt;p&gt;', F.col("event_type"), "&lt;/p&gt;</content><author><name> who </name></author>", dated, "</entry>")
    bodies = _feeds(spark, sf_dir, piece, '<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title>', "</feed>")
    return sources.feed_items(sources.parse_feeds(bodies)).select("feed_url", "ord", "guid", "title", "link", "content", "author", "published")


@query(f"""select 'u' || user_id as feed_url, {_ORD}, left(sha256('{_LINK}' || event_id), 16) as guid, event_type as title, 'me' as author, date_trunc('second', ts) as published from events""")
def feed_rdf(spark, sf_dir):
    when = _cat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "Z")
    piece = _cat("<item><title>", F.col("event_type"), "</title><link>", _LINK, _text_id(), "</link><dc:creator>me</dc:creator><dc:date>", when, "</dc:date></item>")
    bodies = _feeds(spark, sf_dir, piece, '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title></channel>', "</rdf:RDF>")
    return sources.feed_items(sources.parse_feeds(bodies)).select("feed_url", "ord", "guid", "title", "author", "published")


@query(f"""select 'u' || user_id as path, {_ORD}, 'https://f.com/' || event_id as url, event_type || ' & co' as title, case when event_id % 2 = 0 then 'https://s.com' else '' end as site_url, case when event_id % 3 = 0 then 'All/' || event_type else 'All' end as category from events""")
def opml_import(spark, sf_dir):
    own = _cat('<outline text="x" title="', F.col("event_type"), ' &amp; co" xmlUrl="https://f.com/', _text_id(), '"', F.when(F.col("event_id") % 2 == 0, ' htmlUrl="https://s.com"').otherwise(""), "/>")
    piece = F.when(F.col("event_id") % 3 == 0, _cat('<outline text="', F.col("event_type"), '">', own, "</outline>")).otherwise(own)
    bodies = _feeds(spark, sf_dir, piece, '<?xml version="1.0"?><opml version="2.0"><body><outline text="All">', "</outline></body></opml>")
    return sources.opml_feeds(bodies.withColumnRenamed("feed_url", "path"))


@query("""with i as (select user_id, event_id, ts, event_id % 3 as batch from events), k as (select *, row_number() over (partition by user_id order by date_trunc('second', ts) desc, event_id::varchar) as n from i)
  select 'u' || user_id as feed_url, event_id::varchar as guid, date_trunc('second', ts) as published from k where n <= 100""")
def feed_poll_stream(spark, sf_dir):
    """The stored items after a stream of polls: each feed comes in three parts, one of them twice, and one poll is in error."""
    when = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    piece = _cat("<item><title>", F.col("event_type"), "</title><guid>", _text_id(), "</guid><pubDate>", when, " +0000</pubDate></item>")
    base = f"{shared_folder(spark)}/polls-{uuid.uuid4().hex}"
    for part in (0, 1, 2, 0):
        rows = table(spark, sf_dir, "events").where(F.col("event_id") % 3 == part)
        bodies = _joined(rows, F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id"), piece, '<rss version="2.0"><channel><title>T</title>', "</channel></rss>")
        polls = bodies.select(F.col("key").alias("feed_url"), F.lit("2024-01-01T00:00:00").alias("fetched_at"), "body", F.lit("").alias("error"))
        polls = polls.unionByName(polls.limit(1).select("feed_url", "fetched_at", F.lit("").alias("body"), F.lit("timeout").alias("error")))
        polls.write.mode("append").json(f"{base}/in")
        stream.poll_batches(stream.read_polls(spark, f"{base}/in", _FILES), f"{base}/items", f"{base}/checkpoint").awaitTermination()
    return stream.stored_items(spark, f"{base}/items").select("feed_url", "guid", "published")


@query("""with e as (select 'u' || user_id as feed_url, event_id, ts, event_type in ('click', 'error') as mark, (event_id % 9)::varchar as slot from events),
  i as (select feed_url, event_id::varchar as guid, lead(ts, 5) over (partition by feed_url order by ts, event_id::varchar) as gone from e where not mark),
  m as (select feed_url, slot as guid, ts, lead(ts) over (partition by feed_url, slot order by ts) as next from e where mark)
  select feed_url, guid, 'evicted' as change, gone as at from i where gone is not null union all
  select feed_url, guid, 'expired', ts + interval 10 days from m where coalesce(next, (select max(ts) from events)) >= ts + interval 10 days""")
def feed_state_stream(spark, sf_dir):
    """What falls out of the keyed state of feeds: items beyond the newest five of a feed, and read marks ten days after they were made or renewed; the events come in four parts by time."""
    e = table(spark, sf_dir, "events")
    mark = F.col("event_type").isin("click", "error")
    rows = e.select(_cat("u", F.col("user_id").cast("string")).alias("feed_url"), F.when(mark, (F.col("event_id") % 9).cast("string")).otherwise(_text_id()).alias("guid"), F.when(mark, "read").otherwise("item").alias("kind"), F.col("ts").alias("at"))
    base = f"{shared_folder(spark)}/marks-{uuid.uuid4().hex}"
    for part in range(4):
        rows.where(F.floor((F.dayofyear("at") - 1) / 8) == part).write.mode("append").parquet(f"{base}/log")
        marks.log_changes(spark.readStream.schema(marks.LOG).parquet(f"{base}/log"), f"{base}/changes", f"{base}/checkpoint", n=5, days=10).awaitTermination()
    return spark.read.parquet(f"{base}/changes").where("change in ('evicted', 'expired')")


@query("""with b as (select user_id, event_type, event_id, value, event_id % 3 as part from events), v(version) as (values (1), (2), (3)),
  r as (select version, user_id, event_type, value, row_number() over (partition by version, user_id, event_type order by part desc, event_id desc) as n from b, v where part < version)
  select version, 'u' || user_id as feed_url, event_type as guid, value from r where n = 1""")
def store_versions(spark, sf_dir):
    """Three changes of a store of rows by key, and what each of its versions holds: the last value of each user and kind of event so far."""
    e = table(spark, sf_dir, "events").select(_cat("u", F.col("user_id").cast("string")).alias("feed_url"), F.col("event_type").alias("guid"), "event_id", "value")
    store = KeyedStore(spark, f"{shared_folder(spark)}/values-{uuid.uuid4().hex}", "feed_url string, guid string, event_id long, value double", ["feed_url"])
    keys = ["feed_url", "guid"]
    out = None
    for part in range(3):
        last = e.where(F.col("event_id") % 3 == part).groupBy(*keys).agg(F.max(F.struct("event_id", "value")).alias("last")).select(*keys, "last.*")
        version = store.change(last, lambda rows, new: rows.join(new, keys, "left_anti").unionByName(new))["version"]
        held = store.read(version).select(F.lit(version).alias("version"), "feed_url", "guid", "value")
        out = held if out is None else out.unionByName(held)
    return out


_OWN_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"""select url, {_OWN_HOST} as host, status, md5(html) as body_md5, 'text/html; charset=utf-8' as content_type from (select *, (200 + page_id % 3)::int as status from pages) union all
  select url, 'only ' || {_OWN_HOST}, (200 + page_id % 3)::int, md5(html), '' from pages where {_OWN_HOST} = (select min({_OWN_HOST}) from pages)""")
def archived_pages(spark, sf_dir):
    """All pages from an archive of captured responses that they were written to, and once more those of the first host, for which no other record is opened."""
    archive.register(spark)
    path = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("url", F.lit("").alias("host"), F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("fetched_at"), (200 + F.col("page_id") % 3).cast("int").alias("status"), F.lit("OK").alias("reason"), F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.col("html").alias("body"))
    pages.write.format("webarchive").mode("append").save(path)
    read, again = (spark.read.format("webarchive").load(path) for _ in range(2))  # a frame's scans share the filters that one of them hands down
    first = read.agg(F.min("host").alias("h")).first().h
    one = lambda d, host, kind: d.select("url", host.alias("host"), "status", F.md5("body").alias("body_md5"), kind.alias("content_type"))
    return one(read, F.col("host"), F.col("headers")["Content-Type"]).unionByName(one(again.where(F.col("host") == first), _cat("only ", F.col("host")), F.lit("")))


@query("""select 'https://f.org/' || event_type as feed_url, event_id::varchar as guid, event_type as title from events""")
def feed_polls_from_archive(spark, sf_dir):
    """The items that two refreshes of all feeds leave in the store: each poll is answered from captured responses as of its time, the second of which has all items of the feed. Feeds are captured in pages, so no document has a whole feed."""
    archive.register(spark)
    base = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    piece = _cat("<item><title>", F.col("event_type"), "</title><guid>", _text_id(), "</guid></item>")
    url = _cat("https://f.org/", F.col("event_type"))
    number = F.floor(F.col("event_id") / _PAGE).cast("string")
    for at, rows in ((1000, table(spark, sf_dir, "events").where("event_id % 2 = 0")), (3000, table(spark, sf_dir, "events"))):
        bodies = _joined(rows, F.when(number == "0", url).otherwise(_cat(url, "?page=", number)), F.col("event_id"), piece, '<rss version="2.0"><channel><title>T</title>', "</channel></rss>")
        bodies.select(F.col("key").alias("url"), F.lit("").alias("host"), F.timestamp_seconds(F.lit(at)).alias("fetched_at"), F.lit(200).alias("status"), F.lit("OK").alias("reason"), F.create_map(F.lit("Content-Type"), F.lit("text/xml")).alias("headers"), "body").write.format("webarchive").mode("append").save(f"{base}/responses")
    files.write_new(spark, f"{base}/feeds", "\n".join(r.url for r in table(spark, sf_dir, "events").select(url.alias("url")).distinct().collect()))
    for now in (1800, 3600):
        files.write_new(spark, f"{base}/clock{now}", str(now))
        polls = spark.readStream.format("feedpolls").option("feeds", f"{base}/feeds").option("responses", f"{base}/responses").option("clock", f"{base}/clock{now}").option("interval", 1800).option("pages", "page").option("concurrency", max(archive.CONCURRENCY, spark.sparkContext.defaultParallelism)).load()
        stream.poll_batches(polls, f"{base}/items", f"{base}/checkpoint", n=0).awaitTermination()
    return stream.stored_items(spark, f"{base}/items").select("feed_url", "guid", "title")


# ---- search --------------------------------------------------------------------------------------

_FIRST = "(select *, row_number() over (partition by user_id, {0} order by event_id) as seen from events)"
_RANK = "row_number() over (partition by user_id order by event_id)::int as rank"


@query(f"""select 'u' || user_id as query, 'duckduckgo' as provider, {_RANK}, event_type || ' & x' as title, 'https://www.' || event_type || '.com/a b?k=' || event_id % 7 as url, 'about ' || event_id as snippet, event_type || '.com' as domain
  from {_FIRST.format("event_type, event_id % 7")} where seen = 1""")
def search_duckduckgo(spark, sf_dir):
    url = _cat("https://www.", F.col("event_type"), ".com/a b?k=", (F.col("event_id") % 7).cast("string"))
    piece = _cat('<div class="result"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg=', F.url_encode(url), '&amp;rut=1">', F.col("event_type"), ' &amp; x</a></h2><a class="result__snippet">about <b>', _text_id(), "</b></a></div>")
    pages = _feeds(spark, sf_dir, piece, "<html><body>", "</body></html>").select(F.col("feed_url").alias("query"), F.col("body").alias("html"))
    return search.html_results(pages, "duckduckgo")


@query(f"""select 'u' || user_id as query, 'hackernews' as provider, {_RANK}, event_type as title, case when event_id % 2 = 0 then 'https://www.a.org/' || event_id else 'https://news.ycombinator.com/item?id=' || event_id end as url,
  event_id % 50 || ' points · 0 comments · by me' as snippet, case when event_id % 2 = 0 then 'a.org' else 'news.ycombinator.com' end as domain from (select *, row_number() over (partition by user_id order by event_id) as n from events) where n <= 25""")
def search_hackernews(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hit = F.struct(_text_id().alias("objectID"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 2 == 0, _cat("https://www.a.org/", _text_id())).alias("url"), (F.col("event_id") % 50).alias("points"), F.lit("me").alias("author"))
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", hit.alias("h")))).alias("s"))
    answers = rows.select(_cat("u", F.col("user_id").cast("string")).alias("query"), F.to_json(F.struct(F.transform("s", lambda x: x["h"]).alias("hits"))).alias("body"))
    return search.json_results(answers, "hackernews")


@query("""select 'w' || event_id as word, '/x/' as phonetic, m::int as meaning_ord, case when m = 0 then 'noun' else 'verb' end as part_of_speech, 0 as definition_ord, event_type || m as definition, case when m = 0 then '' else 'e.g.' end as example
  from events, (values (0), (1)) t(m) where m = 0 or event_id % 2 = 0""")
def dictionary_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = _cat('{"partOfSpeech":"noun","definitions":[{"definition":"', F.col("event_type"), '0"}]}')
    two = F.when(F.col("event_id") % 2 == 0, _cat(',{"partOfSpeech":"verb","definitions":[{"definition":"', F.col("event_type"), '1","example":"e.g."}]}')).otherwise("")
    return search.dictionary(e.select(_cat("w", _text_id()).alias("word"), _cat('[{"word":"w","phonetic":"/x/","meanings":[', one, two, "]}]").alias("body")))


@query(f"""select url, case when event_id % 3 = 0 then event_type || '/r' when event_id % 3 = 1 then 'A & B ' || event_id else 'Watch' end as title, case when event_id % 3 = 0 then 'does ' || event_type when event_id % 3 = 1 then 'about it' else 'by me' end as description,
  case when event_id % 3 = 0 then 'GitHub' when event_id % 3 = 1 then '' else 'YouTube' end as site_name from (select *, case when event_id % 3 = 0 then 'https://github.com/' when event_id % 3 = 1 then 'https://other.org/' else 'https://www.youtube.com/' end || event_id as url from events)""")
def link_previews(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    url = _cat(F.when(kind == 0, "https://github.com/").when(kind == 1, "https://other.org/").otherwise("https://www.youtube.com/"), _text_id())
    page = _cat('<html><head><title>A &amp; B ', _text_id(), '</title><meta name="description" content="about it"></head></html>')
    body = F.when(kind == 0, _cat('{"full_name":"', F.col("event_type"), '/r","description":"does ', F.col("event_type"), '"}')).when(kind == 1, page).otherwise('{"title":"Watch","author_name":"by me"}')
    return search.preview_any(e.select(url.alias("url"), body.alias("body")))


# ---- discussions ---------------------------------------------------------------------------------

_PLAIN = COLLAPSED.format("coalesce(text, '')")


@query(f"""with c as (select *, row_number() over (partition by conv_id order by turn) - 1 as k from conversations), p as (select *, (k % 3)::int as d from c)
  select conv_id as page_id, k::int as ord, 'c' || turn as id, role as author, k || ' hours ago' as age, d as indent, {_PLAIN} as text, false as deleted, case when d > 0 then 'c' || lag(turn) over (partition by conv_id order by turn) end as parent from p""")
def discussion_threads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    begun = lambda x, k: _cat('<tr class="athing comtr" id="c', x["turn"].cast("string"), '"><td class="ind" indent="', (k % 3).cast("string"), '"></td><td><a class="hnuser">', x["role"], "</a>")
    said = lambda x, k: _cat('<span class="age">', k.cast("string"), ' hours ago</span><div class="commtext">', escape(F.coalesce(x["text"], F.lit(""))), "</div></td></tr>")
    row = lambda x, k: _cat(begun(x, k), said(x, k))
    pages = rows.select(F.col("conv_id").alias("page_id"), _cat("<table>", F.array_join(F.transform("s", row), ""), "</table>").alias("html"))
    return search.comments_of(pages).select("page_id", "ord", "id", "author", "age", "indent", "text", "deleted", "parent")


@query(f"""select user_id as page_id, {_ORD}, (row_number() over (partition by user_id order by event_id))::int as rank, event_type as title, case when event_id % 2 = 0 then 'https://a.com/' || event_id else 'https://news.ycombinator.com/item?id=' || event_id end as href,
  (event_id % 90)::int as points, 'me' as author, (event_id % 9)::int as comments from events""")
def discussion_stories(spark, sf_dir):
    return search.stories_of(_story_pages(spark, sf_dir)).select("page_id", "ord", "rank", "title", "href", "points", "author", "comments")


def _story_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    ident = lambda x: x["event_id"].cast("string")
    href = lambda x: F.when(x["event_id"] % 2 == 0, _cat("https://a.com/", ident(x))).otherwise(_cat("item?id=", ident(x)))
    title = lambda x, k: _cat('<tr class="athing"><td><span class="rank">', (k + 1).cast("string"), '.</span></td><td><span class="titleline"><a href="', href(x), '">', x["event_type"], "</a></span></td></tr>")
    figures = lambda x: _cat('<tr><td><span class="score">', (x["event_id"] % 90).cast("string"), ' points</span> by <a class="hnuser">me</a> <a>', (x["event_id"] % 9).cast("string"), " comments</a></td></tr>")
    row = lambda x, k: _cat(title(x, k), figures(x))
    return rows.select(F.col("user_id").alias("page_id"), _cat("<table>", F.array_join(F.transform("s", row), ""), "</table>").alias("html"))


# ---- pages with what the test pages lack ---------------------------------------------------------

_DAY = "strftime(ts, '%Y-%m-%d')"


def _made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each user: meta tags, a feed, a list of articles and a table with a header."""
    e = table(spark, sf_dir, "events")
    card = lambda x: _cat('<article><h2><a href="/e/', x["event_id"].cast("string"), '">Story number ', x["event_id"].cast("string"), " of the day</a></h2><p>A description of thirty bytes &amp; more, of ", x["event_type"], '.</p><time datetime="', F.date_format(x["ts"], "yyyy-MM-dd"), '">then</time><span class="author">By me</span></article>')
    row = lambda x: _cat("<tr><td>", x["event_id"].cast("string"), '<td><a href="/v/', x["event_id"].cast("string"), '">', x["event_type"], "</a></tr>")
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "ts"))).alias("s"))
    user = F.col("user_id").cast("string")
    head = _cat('<html lang="en-GB"><head><title>Not this</title><meta name="theme-color" content="#1a2b3', F.hex(F.col("user_id") % 16), '"><meta property="og:title" content="User ', user, ' &amp; co"><meta content="About ', user, '" name="description"><meta property="og:site_name" content="Site">')
    head = _cat(head, '<meta property="og:type" content="video.other"><link rel="alternate" type="application/rss+xml" title="F" href="/u', user, '.rss"></head><body>')
    articles = F.array_join(F.transform("s", card), "")
    cells = F.array_join(F.transform("s", row), "")
    return rows.select(F.col("user_id").alias("page_id"), _cat("https://m.org/u/", user).alias("url"), _cat(head, "<main>", articles, "</main></body></html>").alias("html"), _cat(head, "<table><tr><th>Id<th>Kind</tr>", cells, "</table></body></html>").alias("tables"))


@query(f"""select user_id as page_id, {_ORD}, 'Story number ' || event_id || ' of the day' as title, '/e/' || event_id as href, 'A description of thirty bytes & more, of ' || event_type || '.' as description, 'me' as author, strftime(ts, '%b ') || day(ts) || strftime(ts, ', %Y') as date
  from events where user_id in (select user_id from events group by user_id having count(*) >= 3)""")
def listed_articles(spark, sf_dir):
    rows = content.page_parts(_made_pages(spark, sf_dir), ["articles"]).select("page_id", F.inline("articles"))
    return rows.select("page_id", "ord", "title", "href", "description", "author", "date")


@query("""with c as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as y from events), u as (select distinct user_id from events)
  select user_id as page_id, y::int as row, 0 as col, false as is_header, event_id::varchar as text, '' as href from c union all select user_id, y::int, 1, false, event_type, '/v/' || event_id from c
  union all select user_id, 0, 0, true, 'Id', '' from u union all select user_id, 0, 1, true, 'Kind', '' from u""")
def data_cells(spark, sf_dir):
    rows = content.page_parts(_made_pages(spark, sf_dir), ["cells"], html="tables").select("page_id", F.inline("cells"))
    return rows.select("page_id", "row", "col", "is_header", "text", "href")


@query("""select distinct user_id as page_id, 'User ' || user_id || ' & co' as title, 'About ' || user_id as description, 'Site' as site_name, 'Video' as content_type, 'en' as lang, '/u' || user_id || '.rss' as feed,
  '#1a2b3' || substr('0123456789abcdef', (user_id % 16)::int + 1, 1) as candidate from events""")
def page_heads(spark, sf_dir):
    pages = _made_pages(spark, sf_dir)
    parts = content.page_parts(pages, ["lang", "feeds", "theme"]).select("page_id", "lang", F.col("feeds")[0]["url"].alias("feed"), F.lower(F.col("theme")[2]).alias("candidate"))
    return links.meta_tags(pages).join(parts, "page_id").select("page_id", "title", "description", "site_name", "content_type", "lang", "feed", "candidate")


@query(f"""with s as (select *, {_ORD}, case when event_id % 2 = 0 then 'https://a.com/' || event_id else 'item?id=' || event_id end as href, event_type || ' (' || event_id % 90 || ' points, ' || event_id % 9 || ' comments)' as said from events)
  select user_id as page_id, ord * 2 as ord, 'paragraph' as type, said as text, '' as href from s union all select user_id, ord * 2 + 1, 'link', event_type, href from s""")
def story_nodes(spark, sf_dir):
    """The default reading of pages that are tables of stories."""
    return content.content_of(_story_pages(spark, sf_dir)).select("page_id", "ord", "type", "text", "href")


#: Hosts, and the rule that each breaks.
_HOSTS = [
    ("a.b.livejournal.com", "blog"), ("x.blogspot.de", "blog"), ("livejournal.com", ""), ("blogspot.com", ""), ("51dzw.com", ""), ("q.51dzw.com.cn", ""), ("q.hotic.51dzw.com", "spam"), ("Dl.Softonic.Com", "download"), ("me.listal.com", "other"),
    ("www.facebook.com", "social"), ("mail.google.co.uk", "big"), ("google.com", ""), ("cdn.gstatic.com", "big"), ("bit.ly", "shortener"), ("Bit.ly", ""), ("win.click", "ending"), ("my.top", "ending"), ("a.desktop.top", ""), ("short.xyz", ""),
    ("a-rather-long-name.xyz", "ending"), ("-dash.com", "start"), ("nodot", "no_dot"), ("a.b", "size"), ("münchen.de", "not_ascii"), ("good.example.org", ""),
]
_RULED = ["start", "no_dot", "size", "spam", "blog", "download", "other", "social", "big", "shortener", "ending", "not_ascii"]


@query(f"""with h(k, host, rule) as (values {", ".join(f"({k}, '{h}', '{r}')" for k, (h, r) in enumerate(_HOSTS))}), e as (select rule from events join h on h.k = event_id % {len(_HOSTS)})
  select count(*) as before, count_if(rule = '') as after, {", ".join(f"count_if(rule = '{r}') as by_{r}" for r in _RULED)} from e""")
def link_rules_hit(spark, sf_dir):
    """Links to hosts that break each of the clean-up rules, by rule."""
    hosts = F.array(*[F.lit(h) for h, _ in _HOSTS])
    return links.clean_up_report(table(spark, sf_dir, "events").select(F.get(hosts, (F.col("event_id") % len(_HOSTS)).cast("int")).alias("to_domain")))


@query("""select user_id as page_id, 'story' as kind, event_type as text, case when event_id % 2 = 0 then 'https://a.com/' || event_id else 'https://news.ycombinator.com/item?id=' || event_id end as detail from events
  union all select user_id, 'link', t, h from (select user_id, event_type as t, case when event_id % 2 = 0 then 'https://a.com/' || event_id else 'item?id=' || event_id end as h from events union all select user_id, 'me', '' from events union all select user_id, event_id % 9 || ' comments', '' from events)""")
def handled_pages(spark, sf_dir):
    """Stories and links of pages by two handlers of one table function, joined laterally."""
    handlers.register(spark)
    name = f"pages_{uuid.uuid4().hex}"
    _story_pages(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(f"select page_id, 'story' as kind, s.title as text, s.href as detail from {name}, lateral site_rows(html, 'stories') s union all select page_id, 'link', l.text, l.href from {name}, lateral site_rows(html, 'links') l")


@query("""select 'u' || user_id as category, event_type || ' & "co"' as title, 'https://f.com/' || event_id as url, case when event_id % 2 = 0 then 'https://s.com' else '' end as site_url, (row_number() over (order by 'u' || user_id, event_type, 'https://f.com/' || event_id) - 1)::int as ord from events""")
def opml_export(spark, sf_dir):
    """All feeds written as one OPML file by many tasks, and read back in its order."""
    e = table(spark, sf_dir, "events")
    feeds = e.select(_cat("https://f.com/", _text_id()).alias("url"), _cat(F.col("event_type"), ' & "co"').alias("title"), F.when(F.col("event_id") % 2 == 0, "https://s.com").otherwise("").alias("site_url"), _cat("u", F.col("user_id").cast("string")).alias("category"))
    path = f"{shared_folder(spark)}/opml-{uuid.uuid4().hex}/feeds.opml"
    documents.save_opml(feeds, path, "Feeds")
    return documents.opml_rows(spark, path).select("category", "title", "url", "site_url", "ord")


# ---- whole pages ---------------------------------------------------------------------------------

_HOST = "regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), '^www[.]', '')"


@query(f"""with h as (select page_id, {_HOST} as host from pages),
  q as (select page_id, count(*) as n, avg(strlen(text)) as size, avg(case when strlen(text) between 10 and 500 and length(regexp_replace(text, '[0-9.]', '', 'g')) > 5 then 1.0 else 0.0 end) as good from {PARAGRAPHS} where text <> '' group by all)
  select page_id, host, case when strlen(host) % 2 = 1 and n >= 3 and size >= 15 and good >= 0.5 then 'rule' else 'default' end as reader from h left join q using (page_id)""")
def pages_read(spark, sf_dir):
    """What reads each page: the rule of its host where it has one and its items are good enough, else the default reading."""
    pages = table(spark, sf_dir, "pages")
    hosts = reading.hosts_of(pages)
    listed = hosts.where(F.octet_length("host") % 2 == 1).select(F.col("host").alias("domain"), F.lit("body").alias("root"), F.lit("p").alias("articles"), F.lit("").alias("title"), F.lit("").alias("layout"))
    return reading.read_pages(pages, listed).select("page_id", "host", "reader")
