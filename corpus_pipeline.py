"""The corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkatlas.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup, storage

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("byte_bpe", bpe.stage),
]

#: The stages learn and encode; SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.written(docs, name)
    return docs
