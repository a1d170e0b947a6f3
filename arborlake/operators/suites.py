"""Judged suites: their validation against rules and analyses, and benchmarks of several embedding models."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validate import errors
from . import evaluation


def relevance_groups() -> Column:
    """A case's groups of acceptable items; a plain list of expected items is one group."""
    return F.when(F.size("groups") > 0, F.col("groups")).when(F.size("expected") > 0, F.array("expected")).otherwise(F.array().cast("array<array<string>>"))


def case_errors() -> Column:
    """What is wrong with a case (case_type, expected, groups): an array of messages, empty if nothing."""
    positive, judged = F.col("case_type") == "positive", F.size(relevance_groups()) > 0
    return errors(
        (F.col("case_type").isin("positive", "negative"), "case_type must be positive or negative"),
        (~positive | judged, "a positive case needs expected evidence"),
        ((F.col("case_type") != "negative") | ~judged, "a negative case has expected evidence"),
        (F.forall("groups", lambda g: F.size(g) > 0), "a group of expected evidence is empty"),
    )


def owner_errors(cases: DataFrame, owners: DataFrame, hashes: DataFrame) -> DataFrame:
    """(case_id, evidence_id, error) of judged evidence that no analysis has, another paper has, or whose document has changed.

    cases: case_id, paper_id (null for any), evidence_id. owners: evidence_id,
    paper_id, document_hash. hashes: paper_id, document_hash as the suite knows it.
    """
    o = owners.groupBy("evidence_id").agg(F.min_by(F.struct(F.col("paper_id").alias("owner"), "document_hash"), F.struct("paper_id", "document_hash")).alias("o")).select("evidence_id", "o.*")
    j = cases.join(o, "evidence_id", "left").join(hashes.select(F.col("paper_id").alias("owner"), F.col("document_hash").alias("expected_hash")), "owner", "left")
    error = (
        F.when(F.col("owner").isNull(), "unknown evidence")
        .when(F.col("paper_id").isNotNull() & (F.col("paper_id") != F.col("owner")), "evidence of another paper")
        .when(F.col("expected_hash").isNotNull() & (F.col("expected_hash") != F.col("document_hash")), "document has changed")
    )
    return j.select("case_id", "evidence_id", error.alias("error")).where("error is not null")


def curated_metrics(cases: DataFrame, returned: DataFrame) -> DataFrame:
    """One row over all cases: means of recall and reciprocal rank, and the share of cases that keep each rule.

    cases: case_id, expected array. returned: case_id, paper_id, rank, tier,
    items (count), tokens, budget. A negative case (nothing expected) passes if nothing is returned.
    """
    r = returned.groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rank", "paper_id")))).alias("at"),
        (F.count("*") == F.countDistinct("paper_id")).alias("distinct_"),
        F.bool_and(F.when(F.col("tier") == "evidence_backed", F.col("items") > 0).otherwise(F.col("items") == 0)).alias("tiers_"),
        F.bool_and(F.col("tokens") <= F.col("budget")).alias("budget_"),
    )
    j = cases.join(r, "case_id", "left")
    papers = F.coalesce(F.map_values("at"), F.array().cast("array<string>"))
    spots = F.filter(F.transform("expected", lambda p: F.array_position(papers, p)), lambda i: i > 0)
    judged = F.size("expected") > 0
    per = j.select(
        judged.alias("judged"), F.when(judged, F.size(spots) / F.size("expected")).alias("recall"), F.when(judged, F.coalesce(1 / F.array_min(spots), F.lit(0.0))).alias("rr"),
        F.when(~judged, F.col("at").isNull()).alias("empty"), *[F.coalesce(c, F.lit(True)).alias(c) for c in ("distinct_", "tiers_", "budget_")],
    )
    one = lambda c: F.round(F.coalesce(F.avg(c), F.lit(1.0)), 6)
    rate = lambda c: one(F.col(c).cast("double"))
    return per.agg(F.count("*").alias("cases"), one("recall").alias("mean_recall"), one("rr").alias("mrr"), rate("empty").alias("negative_pass_rate"), rate("distinct_").alias("duplicate_free_rate"), rate("tiers_").alias("tier_rate"), rate("budget_").alias("budget_rate"))


def embedding_benchmark(models: dict[str, Callable[[], DataFrame] | None], judgements: DataFrame, case: str, item: str) -> list[dict]:
    """Per model its metrics, or why it has none. A model is a function that indexes and searches, returning (case, item, rank); None is a model that is not there."""
    out = []
    for name, search in models.items():
        if search is None:
            out.append({"model": name, "status": "unavailable"})
            continue
        begun = time.perf_counter()
        try:
            row = evaluation.overall(evaluation.per_case(judgements, search(), case, item)).first().asDict()
            out.append({"model": name, "status": "complete", "seconds": round(time.perf_counter() - begun, 3), **row})
        except Exception as error:  # one model's failure is a result, and leaves the others alone
            out.append({"model": name, "status": "failed", "error": f"{type(error).__name__}: {error}"[:500]})
    return out
