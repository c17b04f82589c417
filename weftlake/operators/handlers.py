"""Site handlers as one table function: each handler says what rows it makes of a page, and SQL joins them laterally."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from weftlake.functions.dom import Node, parse
from weftlake.operators import content, search


@dataclass(frozen=True)
class Handler:
    """What reads the pages of a kind of site: the schema of its rows, and how to make them of a page's nodes."""

    schema: str
    rows: Callable[[list[Node]], list[dict]]

    def columns(self) -> StructType:
        """The schema without a session, which a table function's analysis does not have."""
        kinds = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType()}
        return StructType([StructField(name, kinds[kind]) for name, kind in (c.split() for c in self.schema.split(", "))])


HANDLERS: dict[str, Handler] = {
    "stories": Handler("ord int, rank int, title string, href string, site string, points int, author string, age string, comments int", search.discussion_stories),
    "comments": Handler("ord int, id string, author string, age string, indent int, text string, deleted boolean, parent string", lambda n: search.with_parents(search.discussion_comments(n))),
    "links": Handler("ord int, text string, href string, is_image boolean", content.anchors),
    "cells": Handler("table_ord int, row int, col int, is_header boolean, text string, href string", content.table_cells),
    "feeds": Handler("url string, title string, type string", content.feed_links),
}


class SiteRows:
    """site_rows(html, handler): the rows that a handler makes of a page. handler is a constant, which gives the schema; a null or unreadable page has no rows."""

    @staticmethod
    def analyze(html: AnalyzeArgument, handler: AnalyzeArgument) -> AnalyzeResult:
        if not handler.isConstantExpression or handler.value not in HANDLERS:
            raise ValueError(f"handler must be one of {', '.join(sorted(HANDLERS))}")
        return AnalyzeResult(HANDLERS[handler.value].columns())

    def eval(self, html: str | None, handler: str) -> Iterator[tuple]:
        try:
            nodes = parse(html) if html else []
        except ValueError:
            return
        names = HANDLERS[handler].columns().names
        for row in HANDLERS[handler].rows(nodes) if nodes else []:
            yield tuple(row.get(n) for n in names)


def register(spark: SparkSession) -> None:
    """Makes site_rows known to the session's SQL."""
    spark.udtf.register("site_rows", F.udtf(SiteRows))
