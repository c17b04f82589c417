"""Where queries and their DuckDB SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL that decodes the character references of the test pages.
DECODED = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
#: SQL of an expression with runs of white space made one space and the ends trimmed.
COLLAPSED = "trim(regexp_replace({0}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
#: SQL of the paragraphs of each test page's article by place, and of its heading.
PARAGRAPHS = f"""(select page_id, k, {COLLAPSED.format(DECODED.format("regexp_replace(raw, '<[^>]*>', ' ', 'g')"))} as text from (select page_id, unnest(range(0, len(s))) as k, unnest(s) as raw from
  (select page_id, string_split(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)^.*?</h1>', ''), '</p>|</?b>', '', 'g'), '<p>') as s from pages)))"""
HEADINGS = f"""(select page_id, {COLLAPSED.format(DECODED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} as text from pages)"""
