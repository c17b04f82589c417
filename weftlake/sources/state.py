"""Stored state: feeds, favourites and sessions as JSON, rules by domain, configuration in TOML."""

from __future__ import annotations

import re
import tempfile
import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.operators.feeds import MARK_DAYS, live_marks
from weftlake.operators.links import first_by
from weftlake.sources.feeds import FEED, ITEM, READ

FAVOURITE = "url string, title string, added timestamp"
SESSION = "position int, url string, title string, scroll int"
RULE = "domain string, version int, page_type string, matcher struct<url_pattern:string,url_contains:string,has_selector:string,not_selector:string>, selectors map<string,string>, template string, is_default boolean"
#: Bytes of an Arrow batch that passes between the JVM and a Python worker; beside it stand copies in either, for each task of an executor.
BATCH_BYTES = 4 << 20
TABLES = {"feeds": FEED, "items": ITEM, "reads": READ, "favourites": FAVOURITE, "session": SESSION}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. On one machine without the setting (tests) a temporary folder stands in; a cluster must have it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that all executors share")
    return (base or tempfile.gettempdir()).rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES; the bound on rows stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; one that is not there is empty, missing fields are null."""
    path = f"{folder}/{name}"
    return spark.read.schema(TABLES[name]).json(path) if exists(spark, path) else spark.createDataFrame([], TABLES[name])


def save(df: DataFrame, folder: str, name: str, now=None, days: int = MARK_DAYS) -> None:
    """Stores a table. Read marks that have expired by `now` are left out first."""
    if name == "reads" and now is not None:
        df = live_marks(df, now, days)
    df.write.mode("overwrite").json(f"{folder}/{name}")


def clear(spark: SparkSession, folder: str, name: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def add_favourite(favourites: DataFrame, new: DataFrame) -> DataFrame:
    """Favourites with those added whose url is not there yet."""
    return favourites.unionByName(first_by(new, ["url"], "title").join(favourites.select("url"), "url", "left_anti").select(*favourites.columns))


def save_rules(rules: DataFrame, folder: str) -> None:
    """Rules in a folder for each domain; saving replaces the domains that are given."""
    rules.withColumn("key", F.regexp_replace("domain", "[/:]", "_")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").json(folder)


def load_rules(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RULE).json(folder) if exists(spark, folder) else spark.createDataFrame([], RULE)


def all_domains(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Domains with a rule, in memory or stored, each once."""
    return memory.select("domain").union(stored.select("domain")).distinct()


def merge_config(defaults: dict[str, Any], user: dict[str, Any]) -> dict[str, Any]:
    """Defaults with the user's values that are not zero, empty or false; tables are merged by key."""
    out = dict(defaults)
    for k, v in user.items():
        if isinstance(v, dict) and isinstance(defaults.get(k), dict):
            out[k] = merge_config(defaults[k], v)
        elif v:
            out[k] = v
    return out


def load_config(text: str, defaults: dict[str, Any]) -> dict[str, Any]:
    return merge_config(defaults, tomllib.loads(text))
