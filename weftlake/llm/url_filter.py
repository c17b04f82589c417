"""Op 1: URL filters by host-suffix and path-prefix expressions, hash prefixes and full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import small

#: The query's rules: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of pages.

    rules(verdict, host, path): a rule fits its host and all subdomains where the url's path starts with
    its path; the longest rule wins, of equal ones the one that blocks. Each url is expanded
    into (host suffix, path prefix) expressions, of the shapes (labels, path length) that some rule has;
    expressions meet rules on 32 bits of their digest, then the whole digest decides. Without a rule the
    verdict is `otherwise`. A null url has an empty host and path and no rule; repeated rows are
    judged each. Rows are counted by (key, url) first, so a hot host or url is never gathered.
    """
    expression = F.concat_ws("\t", "host", "path")
    rules = rules.select("verdict", "host", "path").distinct()
    named = rules.select(_digest(expression).alias("digest"), F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("cut"))
    shapes = [(r.labels, r.cut) for r in named.select("labels", "cut").distinct().orderBy("labels", "cut").limit(10_001).collect()]
    if len(shapes) > 10_000:
        raise ValueError("rules of more than 10,000 shapes (labels, path length)")
    named = named.select(F.substring("digest", 1, 8).alias("short"), F.col("digest").alias("full"), "rule", "verdict")

    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).groupBy("key", "url").agg(F.count("*").alias("copies"))
    rows = rows.select("key", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffix = lambda n: F.array_join(F.slice(labels, F.size(labels) - (n - 1), n), ".")
    tries = [F.when((F.size(labels) >= n) & (F.length("path") >= cut), _digest(F.concat_ws("\t", suffix(n), F.substring("path", 1, cut)))) for n, cut in shapes]
    tried = rows.withColumn("digest", F.explode_outer(F.filter(F.array(*tries), lambda x: x.isNotNull()) if tries else F.lit(None).cast("array<string>")))
    met = tried.withColumn("short", F.substring("digest", 1, 8)).join(small(named), "short", "left")
    fits = F.col("digest") == F.col("full")
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("size"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule")))).alias("best")
    judged = met.groupBy("key", "url", "copies", "host", "path").agg(best)
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return judged.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths, rules and verdicts of all urls of the table pages; see judge_urls for nulls, urls without a scheme, ties and repeated rows."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


SQL = r"""
with r(verdict, rh, rp) as (values ('block','com','/en/'),('allow','example.com','/en/7'),('allow','net','/de/'),('block','example.net','/de/8'),('block','org','/es/')),
u as (select row_number() over () as k, page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages)
select page_id, any_value(host) as host, any_value(path) as path,
  arg_max(rh || rp, length(rh || rp)) as rule, coalesce(arg_max(verdict, length(rh || rp)), 'allow') as verdict
from u left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by k, page_id
"""
