"""Feedback batches: validation, target check against stored outputs, idempotent append, roll-ups, targets of a response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validate import OPTIONAL, first_record_error, reason_group, signal_scope


def target_error(found: Column, papers: Column) -> Column:
    """Why a record's (request_id, paper_id, point_id) was not delivered; null if it was, or names no request."""
    paper, point = F.col("paper_id"), F.col("point_id")
    missing_paper = paper.isNotNull() & papers.isNull()
    missing_point = paper.isNotNull() & point.isNotNull() & ~F.coalesce(F.array_contains(papers, point), F.lit(False))
    return F.when(F.col("request_id").isNotNull(), F.when(found.isNull(), "request has no archived output").when(missing_paper, "paper was not delivered").when(missing_point, "point was not delivered"))


def acknowledge(records: DataFrame, stored: DataFrame, outputs: DataFrame, order: str | None = None) -> DataFrame:
    """records with status (accepted, duplicate or rejected), error, reason group and scope.

    outputs: request_id, paper_id, point_ids (optional). A record that names a
    request must name what was delivered for it, unless its id is known already.
    Of several valid records of one id in the batch, the first (by `order`, or
    by all that they say) with a delivered target is accepted and later ones are duplicates.
    """
    r = records
    for name, kind in OPTIONAL.items():
        if name not in r.columns:
            r = r.withColumn(name, F.lit(None).cast(kind))
    points = F.col("point_ids") if "point_ids" in outputs.columns else F.array().cast("array<string>")
    delivered = outputs.select("request_id", "paper_id", points.alias("p_")).groupBy("request_id", "paper_id").agg(F.flatten(F.collect_list("p_")).alias("papers_"))
    requests = outputs.select("request_id").distinct().withColumn("found_", F.lit(True))
    seen = stored.select("feedback_id").distinct().withColumn("seen_", F.lit(True))
    j = r.withColumn("error", first_record_error()).join(requests, "request_id", "left").join(delivered, ["request_id", "paper_id"], "left").join(seen, "feedback_id", "left")
    at = F.col(order) if order else F.struct(*[F.to_json(F.struct(c)) for c in records.columns])
    valid, target = F.col("error").isNull(), target_error(F.col("found_"), F.col("papers_"))
    j = j.withColumns({"valid_": valid, "target_": F.when(valid, target), "at_": at})
    # The first of an id that could be stored; equal rows are told apart by their number.
    w = Window.partitionBy("feedback_id", "valid_").orderBy(F.when(F.col("target_").isNull(), 0).otherwise(1), "at_")
    first = F.min(F.when(F.col("target_").isNull(), F.col("at_"))).over(Window.partitionBy("feedback_id", "valid_"))
    j = j.withColumns({"n_": F.row_number().over(w), "first_": first})
    status = (
        F.when(~F.col("valid_"), "rejected")
        .when(F.col("seen_"), "duplicate")
        .when(F.col("target_").isNull() & (F.col("n_") == 1), "accepted")
        .when(F.col("target_").isNull() | (F.col("at_") > F.col("first_")), "duplicate")
        .otherwise("rejected")
    )
    out = j.withColumn("status", status).withColumn("error", F.coalesce("error", F.when(F.col("status") == "rejected", F.col("target_"))))
    return out.select(*records.columns, "status", "error", reason_group(F.col("reason")).alias("reason_group"), signal_scope(F.col("reason")).alias("signal_scope"))


def acknowledgement(acknowledged: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: received, accepted, duplicates, errors, and the sorted unknown reasons and papers (of stored records) that no source (paper_id) has."""
    known = sources.select("paper_id").distinct().withColumn("known_", F.lit(True))
    j = acknowledged.join(known, "paper_id", "left")
    stored = F.col("status") != "rejected"
    names = lambda c, when: F.array_sort(F.collect_set(F.when(when, F.col(c))))
    return j.agg(
        F.count("*").alias("received"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "rejected").alias("errors"),
        names("reason", stored & (F.col("reason_group") == "unknown")).alias("unknown_reasons"),
        names("paper_id", stored & F.col("paper_id").isNotNull() & F.col("known_").isNull()).alias("unresolved_papers"),
    )


def rollup(records: DataFrame) -> DataFrame:
    """Counts by reason with its group, and the scope that tells project-only signals from those about the corpus."""
    r = records.select(F.col("reason"), reason_group(F.col("reason")).alias("reason_group"), signal_scope(F.col("reason")).alias("signal_scope"))
    return r.groupBy("reason", "reason_group", "signal_scope").agg(F.count("*").alias("n"))


def targets(papers: DataFrame, request: str) -> DataFrame:
    """Per request what feedback may refer to: paper ids by rank, distinct point ids in their order, and both per paper."""
    one = F.struct("rank", "paper_id", "tier", "point_ids")
    each = papers.groupBy(request).agg(F.array_sort(F.collect_list(one)).alias("papers"))
    return each.select(request, F.transform("papers", lambda p: p["paper_id"]).alias("paper_ids"), F.array_distinct(F.flatten(F.transform("papers", lambda p: p["point_ids"]))).alias("point_ids"), "papers")


def targets_of_points(points: DataFrame, request: str) -> DataFrame:
    """`targets` of rows (request, rank, paper_id, tier, point_id), one per delivered point: one grouping instead of two.

    Rows of one rank, paper and tier are one paper, whose points stand in the order of their ids. Work per request is in proportion to its sorted points.
    """
    one = F.struct("rank", "paper_id", "tier", "point_id")
    each = points.groupBy(request).agg(F.sort_array(F.collect_list(one)).alias("s_"))
    at = lambda i: F.get("s_", i)
    paper = lambda x: F.struct(x["rank"].alias("rank"), x["paper_id"].alias("paper_id"), x["tier"].alias("tier"))
    first = F.filter(F.sequence(F.lit(0), F.size("s_") - 1), lambda i: (i == 0) | ~paper(at(i)).eqNullSafe(paper(at(i - 1))))
    each = each.withColumn("first_", first)
    end = lambda k: F.coalesce(F.get("first_", k + 1), F.size("s_"))
    ids = lambda i, k: F.transform(F.slice("s_", i + 1, end(k) - i), lambda p: p["point_id"])
    papers = F.transform("first_", lambda i, k: F.struct(at(i)["rank"].alias("rank"), at(i)["paper_id"].alias("paper_id"), at(i)["tier"].alias("tier"), ids(i, k).alias("point_ids")))
    return each.select(request, F.transform("first_", lambda i: at(i)["paper_id"]).alias("paper_ids"), F.array_distinct(F.transform("s_", lambda p: p["point_id"])).alias("point_ids"), papers.alias("papers"))
