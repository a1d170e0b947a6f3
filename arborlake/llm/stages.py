"""Pipeline stages: each takes (spark, docs, sf_dir) and applies one operator to all of docs.

All but the last return rows of docs with docs' columns, whatever further columns
docs has and whatever their names. Rows are told apart by a key of their own
(`_spread.keyed`), so repeated ids and rows without an id are rows like others;
of a group, the row with the smallest id stays, a null being larger than any id,
and one row of equal ones. Null and empty texts: see each stage. Empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, jaccard_join, language_id, packing
from ._scratch import Scratch
from ._spread import keyed

#: A language is rejected when the best one has less than this posterior, or the text has no letter.
MIN_POSTERIOR = 0.5


def _rows(spark: SparkSession, docs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """((row, id_, k_) of each row, (k_, text_) for an operator)."""
    rows = keyed(Scratch(spark, tag), docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_")), "id_", "k_")
    return rows, rows.select("k_", F.col("row.text").alias("text_"))


def _first_of_each(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with the smallest id of each group in found (k_, group)."""
    first = found.join(rows.select("k_", "id_"), "k_").groupBy("group").agg(F.min(F.struct(F.col("id_").isNull().alias("none"), "id_", "k_")).alias("m")).select("m.k_")
    return rows.join(first, "k_", "left_semi").select("row.*")


def _fresh(name: str, taken: list[str]) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes the prediction. Null, empty and letterless texts go.

    Where no row has a language to learn from, nothing can be judged: all texts
    with a letter stay, lang as it is.
    """
    langs, matrix = language_id.train(docs)
    if not langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    pred, score = _fresh("lang_pred", docs.columns), _fresh("score", docs.columns)
    scored = language_id.predict(spark, docs, langs, matrix, pred_col=pred, score_col=score)
    kept = scored.where((F.col(pred) != "und") & (F.col(score) >= MIN_POSTERIOR))
    return kept.withColumn("lang", F.col(pred)).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the smallest id. Null and empty texts are one group."""
    rows, texts = _rows(spark, docs, "first")
    found = exact_dedup.exact_dedup(spark, texts, "k_", "text_").select("k_", F.col("text_sha256").alias("group"))
    return _first_of_each(rows, found)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, one row with the smallest id. Null, empty and wordless texts all stay."""
    rows, texts = _rows(spark, docs, "near")
    found = jaccard_join.jaccard_components(spark, texts, "k_", "text_").select("k_", F.col("component_id").alias("group"))
    return _first_of_each(rows, found)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark questions. Null, empty and wordless texts stay, as does all where benchmark is empty."""
    rows, texts = _rows(spark, docs, "leaks")
    leaked = decontaminate.leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "k_", "text_").select("k_").distinct()
    return rows.join(leaked, "k_", "left_anti").select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training windows. Null and empty texts are the end id alone; repeated rows are packed once each."""
    return packing.pack(spark, docs)
