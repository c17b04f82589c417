"""Records of different rules in one table: a VARIANT for each page, with the fields that all rules have as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.functions.urls import normal_host
from weftlake.operators import structure


def variant_records(pages: DataFrame, rules: dict[str, dict[str, str]], which: Column, common: dict[str, list[str]]) -> DataFrame:
    """(page_id, url, host, rule, common fields..., record) of pages(page_id, url, html) by the rule that `which` names for them; a page without a rule or match has no row.

    rules: selectors by the name of a rule. record is a VARIANT of what they extract (see structure.records), so rules may differ in fields and nesting and are read by path, as in try_variant_get(record, '$.Menu[0].text', 'string').
    common: for each column the fields that hold it in one rule or another, as text; they are taken out of the record once, here, so that filters on them are filters on columns. Pages are parsed once, in one pass.
    """
    named = pages.select("page_id", "url", normal_host(F.col("url")).alias("host"), which.alias("rule"), "html").where(F.col("rule").isin(*rules) if rules else F.lit(False))
    nodes = structure.page_nodes(named)
    out = None
    for name, selectors in sorted(rules.items()):
        own = nodes.join(named.where(F.col("rule") == name).select("page_id"), "page_id", "left_semi") if len(rules) > 1 else nodes
        found = structure.records(own, selectors)
        fields = [c for c in found.columns if c != "page_id"]
        made = found.select("page_id", F.lit(name).alias("rule"), F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("record"))
        out = made if out is None else out.unionByName(made)
    if out is None:
        return named.select("page_id", "url", "host", "rule", *[F.lit("").alias(c) for c in common], F.parse_json(F.lit("{}")).alias("record"))
    texts = [F.coalesce(*[F.try_variant_get("record", f"$.{f}", "string") for f in fields], F.lit("")).alias(c) for c, fields in common.items()]
    return named.drop("html").join(out, ["page_id", "rule"]).select("page_id", "url", "host", "rule", *texts, "record")


def many(record: Column, path: str, kind: str) -> Column:
    """What stands at a path of a record as an array<kind>; null where there is nothing of that kind."""
    return F.try_variant_get(record, path, f"array<{kind}>")
