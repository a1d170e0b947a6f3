"""Retrieval metrics from judgements and ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_case(judgements: DataFrame, hits: DataFrame, case: str, item: str, cutoffs: tuple[int, ...] = (5, 8)) -> DataFrame:
    """One row per case: expected, found, recall, first rank, reciprocal rank, recall at cutoffs. Cases without hits stay."""
    j = judgements.select(case, item).distinct()
    found = j.join(hits.select(case, item, "rank"), [case, item], "left")
    at = [F.round(F.try_divide(F.count_if(F.col("rank") <= k), F.count("*")), 6).alias(f"recall_at_{k}") for k in cutoffs]
    return found.groupBy(case).agg(
        F.count("*").alias("expected"),
        F.count("rank").alias("found"),
        F.round(F.count("rank") / F.count("*"), 6).alias("recall"),
        F.min("rank").alias("first_rank"),
        F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        *at,
    )


def overall(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("cases"),
        F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.count_if(F.col("found") > 0) / F.count("*"), 6).alias("hit_rate"),
    )


def group_recall(groups: DataFrame, hits: DataFrame, case: str, group: str, item: str) -> DataFrame:
    """Micro recall over groups (any member found) and the share of cases with all their groups found."""
    g = groups.join(hits.select(case, item, F.lit(1).alias("h")), [case, item], "left").groupBy(case, group).agg(F.coalesce(F.max("h"), F.lit(0)).alias("hit"))
    c = g.groupBy(case).agg(F.sum("hit").alias("hit"), F.count("*").alias("n"))
    return c.agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("group_recall"), F.round(F.count_if(F.col("hit") == F.col("n")) / F.count("*"), 6).alias("full_case_recall"))


def negatives(cases: DataFrame, hits: DataFrame, case: str) -> DataFrame:
    """Share of negative cases that return nothing."""
    n = cases.join(hits.select(case).distinct().withColumn("h", F.lit(1)), case, "left")
    return n.agg(F.count("*").alias("negatives"), F.round(F.count_if(F.col("h").isNull()) / F.count("*"), 6).alias("no_match_rate"))


def separation(scores: DataFrame, relevant: str, score: str) -> DataFrame:
    return scores.agg(F.round(F.avg(F.when(F.col(relevant), F.col(score))) - F.avg(F.when(~F.col(relevant), F.col(score))), 6).alias("separation"))


def package_profiles(packages: DataFrame) -> DataFrame:
    """Per profile: packages, how many kept to their budget, mean and largest token estimate."""
    return packages.groupBy("profile").agg(F.count("*").alias("packages"), F.count_if(F.col("tokens") <= F.col("budget")).alias("within"), F.round(F.avg("tokens"), 4).alias("mean_tokens"), F.max("tokens").alias("max_tokens"))
