"""Queries over pages whose title was cut within a character reference, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

PAGES = [
    (1, "https://a.org/x", "Cut here&amp"), (2, "https://ab.org/y", "Whole &amp; &quot;said&quot;"), (3, "https://abc.org/z", "A&amp;copy &b &copy; &copy"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    rows = [(k, u, f'<html lang="en"><head><title>{t}</title></head><body><nav><ul><li><a href="/m?a=1&amp">{t}</a></li></ul></nav><article><h1>{t}</h1><p>One <b>bold {t}<p>Two</p></article></body></html>') for k, u, t in PAGES]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["page_headings", "page_text", "page_title_lang", "page_links", "variant_records", "rule_quality"])
def test_cut_references(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want
