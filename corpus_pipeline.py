"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
in the shared scratch folder and rereads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlake.llm.common import Scratch, passing
from weftlake.llm.lang_id import known_language
from weftlake.llm.line_dedup import without_repeats
from weftlake.llm.mixing import mixed
from weftlake.llm.ngram_join import near_distinct
from weftlake.llm.pieces import tokens

STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeats),
    ("ngram_jaccard_join", near_distinct),
    ("source_mixing", mixed),
    ("sentencepiece", tokens),
]

#: Language ID, MinHash, the mix and piece encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with passing():  # what the stage has kept goes when its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
