"""Rank fusion, calibration, diversity and curation, as window expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, *order: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def rrf(rankings: list[tuple[DataFrame, float]], key: str, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (key, rank) lists: sum of w / (k + rank), ranks from 1."""
    cols = [*(by or []), key]
    parts = [df.select(*cols, (F.lit(w) / (k + F.col("rank"))).alias("part")) for df, w in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy(*cols).agg(F.sum("part").alias("rrf"))


def rrf_relevance(score: Column, weights: list[float], k: int = 60) -> Column:
    """Fused score on a 0..1 scale: one list's first place is 0, every list's first place is 1."""
    floor, ceil = max(weights) / (k + 1), sum(weights) / (k + 1)
    scaled = (score - floor) / (ceil - floor) if ceil > floor else F.when(score >= ceil, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def diversity(df: DataFrame, group: str, score: str, penalty: float, by: list[str] | None = None) -> DataFrame:
    """Greedy re-rank that pays `penalty` for each item of the same group already picked.

    Within a group items are taken in score order, so the n-th pays (n - 1)
    penalties whatever else was picked: sorting by that key equals the loop.
    """
    w = Window.partitionBy(*(by or []))
    span = F.max(score).over(w) - F.min(score).over(w)
    norm = F.when(span > 0, (F.col(score) - F.min(score).over(w)) / span).otherwise(F.lit(1.0))
    ranked = df.withColumn("norm_", norm)
    nth = F.row_number().over(Window.partitionBy(*(by or []), group).orderBy(F.col(score).desc(), F.col("position")))
    return ranked.withColumn("key_", F.round(F.col("norm_") - penalty * (nth - 1), 9)).withColumn("new_rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.col("key_").desc(), "position"))).drop("norm_", "key_")


def paper_relevance(sources: list[tuple[str, str, float]], k: int = 60) -> Column:
    """Sum over sources (rank column, relevance column, weight) of w (.25 + .75 rel) / (k + rank), over the best possible."""
    best = sum(w for _, _, w in sources) / (k + 1)
    parts = [F.coalesce(w * (0.25 + 0.75 * F.col(rel)) / (k + F.col(rank)), F.lit(0.0)) for rank, rel, w in sources]
    return reduce(lambda a, b: a + b, parts) / best


def recency(relevance: Column, published: Column, now: Column, half_life_days: float, alpha: float) -> Column:
    """(1 - a) r + a 0.5^(age / half life); no date leaves the relevance as it is."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(published)) / 86400.0)
    return F.when(published.isNull(), relevance).otherwise((1 - alpha) * relevance + alpha * F.pow(F.lit(0.5), age / half_life_days))


def curate(items: DataFrame, paper: str, kind: str, evidence: Column, relevance: str, key: str, limit: int) -> DataFrame:
    """Per paper: distinct evidence sets by relevance, the first of each kind before second ones, up to limit."""
    ev = F.array_join(F.array_sort(evidence), ",")
    best = Window.partitionBy(paper, "ev_").orderBy(F.col(relevance).desc(), key)
    distinct = items.withColumn("ev_", ev).withColumn("d_", F.row_number().over(best)).where("d_ = 1")
    kinds = Window.partitionBy(paper, kind).orderBy(F.col(relevance).desc(), key)
    final = Window.partitionBy(paper).orderBy(F.when(F.col("k_") == 1, 0).otherwise(1), F.col(relevance).desc(), key)
    return distinct.withColumn("k_", F.row_number().over(kinds)).withColumn("item_rank", F.row_number().over(final)).where(F.col("item_rank") <= limit).drop("ev_", "d_", "k_")


def bounded_picks(df: DataFrame, categories: list[str], category: Column, key: str, order: list[Column], limit: int) -> DataFrame:
    """Category by category, the first `limit` rows not picked for an earlier one (a loop over the few categories)."""
    picked = None
    for c in categories:
        pool = df.where(category == c)
        if picked is not None:
            pool = pool.join(picked.select(key), key, "left_anti")
        part = pool.orderBy(*order).limit(limit).withColumn("picked_for", F.lit(c))
        picked = part if picked is None else picked.unionByName(part)
    return picked


def month_gaps(df: DataFrame, ts: str) -> DataFrame:
    """Months without rows between months with rows."""
    months = df.select(F.date_trunc("month", ts).cast("date").alias("m")).where("m is not null").distinct()
    bounds = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null")
    every = bounds.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    return every.join(months, "m", "left_anti").select(F.date_format("m", "yyyy-MM").alias("month"))


def top_else_other(df: DataFrame, column: str, n: int) -> DataFrame:
    top = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(column, F.lit(True).alias("in_top"))
    return df.join(F.broadcast(top), column, "left").withColumn("bucket", F.when(F.col("in_top"), F.col(column)).otherwise("Other")).drop("in_top")


def above_relevance(hits: DataFrame, tie: str, limit: int, least: float = 0.05, relevance: str = "relevance") -> DataFrame:
    """The best `limit` hits of at least that relevance; ties go to the smaller key."""
    return hits.where(F.col(relevance) >= least).orderBy(F.desc(relevance), tie).limit(limit)


def metadata_matches(categories: list[str] | None = None, start_year: int | None = None, end_year: int | None = None) -> Column:
    """Whether a paper's merged metadata (categories, update_year) meets the filters; without a year it fails any bound."""
    ok = F.lit(True)
    if categories:
        ok = ok & F.coalesce(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])), F.lit(False))
    if start_year is not None:
        ok = ok & F.coalesce(F.col("update_year") >= start_year, F.lit(False))
    if end_year is not None:
        ok = ok & F.coalesce(F.col("update_year") <= end_year, F.lit(False))
    return ok


def distribution(df: DataFrame, column: str, width: int = 40) -> DataFrame:
    """(column, n, percent, bar): counts, their share of all, and a bar as long as the count relative to the largest."""
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("all_"), F.max("n").alias("max_"))
    j = c.join(F.broadcast(total))
    return j.select(column, "n", F.round(100 * F.col("n") / F.col("all_"), 6).alias("percent"), F.expr(f"repeat('█', cast(floor(n * {width} / max_) as int))").alias("bar"))
