"""From documents to packed training windows: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import stages
from arborlake.llm._scratch import Scratch, made, sweep

STAGES = [
    ("language_id", stages.identify_language),
    ("exact_dedup", stages.keep_first_copies),
    ("jaccard_join", stages.keep_one_of_near_copies),
    ("decontaminate", stages.drop_benchmark_leaks),
    ("packing", stages.pack_windows),
]

#: Token ids and packing have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since, before = made(), None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        sweep(spark, since, scratch)
        if before is not None:
            scratch.drop(before)
        before = docs
        scratch.free_shuffles()
    return docs
