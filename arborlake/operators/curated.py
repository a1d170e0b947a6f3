"""Curated search: two retrievers, fusion, metadata, filters, curation, final order, coverage, budget, trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context, ranking

EVIDENCE_WEIGHT, DISCOVERY_WEIGHT = 1.2, 1.0
NO_MATCH = "No paper of an available source met the filters."


class SearchUnavailable(RuntimeError):
    """No source could be read."""


def candidate_limit(limit: int, minimum: int = 50, multiplier: int = 4, cap: int = 200) -> int:
    return min(cap, max(limit, minimum, limit * multiplier))


def pulled(spark, name: str, pull: Callable[[int], DataFrame], n: int, least: float) -> tuple[DataFrame | None, dict]:
    """(a source's at most n candidates of enough relevance, its coverage). They are fetched here, so a source that fails does so here."""
    try:
        hits = pull(n)
        rows = hits.where(F.col("relevance") >= least).orderBy("rank").limit(n).collect()
    except Exception as error:  # what is wrong with a source is told in its coverage, and leaves the other one
        return None, {"source": name, "status": "unavailable", "returned_candidates": 0, "error": f"{type(error).__name__}: {error}"[:500]}
    return spark.createDataFrame(rows, hits.schema), {"source": name, "status": "matches" if rows else "no_match", "returned_candidates": len(rows)}


def curated_search(
    evidence: Callable[[int], DataFrame],
    discovery: Callable[[int], DataFrame],
    metadata: DataFrame,
    paper: str,
    limit: int,
    now: str,
    half_life: float = 365.0,
    alpha: float = 0.1,
    items_per_paper: int = 3,
    min_relevance: float = 0.0,
    categories: list[str] | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
    report: dict | None = None,
) -> DataFrame:
    """Papers with rank, relevance, tier and best items.

    evidence(n) gives (paper, point, kind, evidence_ids, relevance, rank) hits,
    discovery(n) (paper, relevance, rank); one of them may fail, both may not.
    metadata has paper, published and whatever else to show; filters hold for the
    merged metadata (categories, update_year), so that they apply to a paper from
    either source. report gets the coverage: each source's status, candidates,
    papers by tier, whether a source is missing.
    """
    spark, n = metadata.sparkSession, candidate_limit(limit)
    ev, ev_cover = pulled(spark, "evidence", evidence, n, min_relevance)
    di, di_cover = pulled(spark, "discovery", discovery, n, min_relevance)
    if ev is None and di is None:
        raise SearchUnavailable(f"evidence: {ev_cover['error']}; discovery: {di_cover['error']}")
    key_type = dict(metadata.dtypes)[paper]

    def per_paper(df: DataFrame | None, tag: str) -> DataFrame:
        if df is None:
            return spark.createDataFrame([], f"{paper} {key_type}, first_{tag} int, rel_{tag} double, rank_{tag} int")
        best = df.groupBy(paper).agg(F.min("rank").alias(f"first_{tag}"), F.max("relevance").alias(f"rel_{tag}"))
        return ranking.with_rank(best, F.col(f"first_{tag}"), F.col(paper), name=f"rank_{tag}")

    fused = per_paper(ev, "e").join(per_paper(di, "d"), paper, "full_outer").join(metadata, paper, "left")
    if categories or start_year is not None or end_year is not None:
        fused = fused.where(ranking.metadata_matches(categories, start_year, end_year))
    base = ranking.paper_relevance([("rank_e", "rel_e", EVIDENCE_WEIGHT), ("rank_d", "rel_d", DISCOVERY_WEIGHT)])
    rel = ranking.recency(base, F.col("published"), F.lit(now).cast("timestamp"), half_life, alpha)
    scored = fused.withColumn("relevance", F.round(rel, 6)).withColumn("tier", F.when(F.col("rel_e").isNotNull(), 1).otherwise(0))
    order = [F.desc("relevance"), F.desc("tier"), F.desc(F.greatest("rel_e", "rel_d")), F.desc(F.coalesce(F.year("published"), F.lit(0))), F.desc(paper)]
    top = ranking.with_rank(scored.orderBy(*order).limit(limit), *order, name="final_rank")
    if report is not None:
        report |= coverage([ev_cover, di_cover], scored.count(), top)
    if ev is None:
        return top.withColumn("items", F.array().cast("array<string>"))
    best = ranking.curate(ev.join(top.select(paper), paper, "left_semi"), paper, "kind", F.col("evidence_ids"), "relevance", "point", items_per_paper)
    items = best.groupBy(paper).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_rank", F.col("point").cast("string").alias("p")))), lambda x: x["p"]).alias("items"))
    return top.join(items, paper, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def coverage(sources: list[dict], candidates: int, top: DataFrame) -> dict:
    """What a search has seen and returns, by source and tier."""
    tiers = {r["tier"]: r["n"] for r in top.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    back, only = tiers.get(1, 0), tiers.get(0, 0)
    return {
        "sources": sources,
        "source_candidates": sum(s["returned_candidates"] for s in sources),
        "unique_candidate_papers": candidates,
        "returned_papers": back + only,
        "evidence_backed_papers": back,
        "metadata_only_papers": only,
        "partial": any(s["status"] == "unavailable" for s in sources),
        "result_status": "matches" if back + only else "no_match",
        "no_match_reason": None if back + only else NO_MATCH,
    }


def fallback_metadata(papers: DataFrame, paper: str, site: str = "https://arxiv.org") -> DataFrame:
    """Metadata where the stores have none: the title of an evidence hit, else of the discovery hit, else the id; authors from one string.

    papers: paper, and from the hits (null where there is none) evidence_title, discovery_title, abstract, authors, categories, update_date.
    """
    names = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), " and "), lambda a: F.trim(a)), lambda a: a != "")
    return papers.select(
        paper, F.coalesce("evidence_title", "discovery_title", F.col(paper).cast("string")).alias("title"), "abstract", names.alias("authors"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "update_date",
        F.concat(F.lit(f"{site}/abs/"), F.col(paper).cast("string")).alias("abs_url"), F.concat(F.lit(f"{site}/pdf/"), F.col(paper).cast("string")).alias("pdf_url"),
    )


def respond(result: DataFrame, paper: str, budget: int, cover: dict | None = None) -> dict:
    """The response document of at most a few dozen papers, fitted to the budget."""
    shown = [c for c in ("title", "abstract") if c in result.columns]
    rows = [r.asDict(recursive=True) for r in result.select(paper, "final_rank", "relevance", "tier", "items", *shown).orderBy("final_rank").collect()]
    return context.fit_response({"papers": rows, "coverage": dict(cover or {})}, budget)


class Trace:
    """The runs of a search service as append-only rows under one folder: a run's latest row is its state."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{self.root}/{table}")

    def start(self, request_id: str, query: str, at: str) -> None:
        self._append("runs", [(request_id, 0, "running", at, query, None)], "request_id string, step int, status string, at string, query string, error string")

    def pulls(self, request_id: str, sources: list[dict]) -> None:
        rows = [(request_id, s["source"], s["status"], s["returned_candidates"], s.get("error")) for s in sources]
        self._append("pulls", rows, "request_id string, source string, status string, candidates long, error string")

    def complete(self, request_id: str, result: DataFrame, at: str) -> None:
        result.withColumn("request_id", F.lit(request_id)).write.mode("append").parquet(f"{self.root}/outputs")
        self._append("runs", [(request_id, 1, "complete", at, None, None)], "request_id string, step int, status string, at string, query string, error string")

    def fail(self, request_id: str, error: str, at: str) -> None:
        self._append("runs", [(request_id, 1, "failed", at, None, error[:500])], "request_id string, step int, status string, at string, query string, error string")

    def runs(self) -> DataFrame:
        """Each request with its latest status."""
        r = self.spark.read.parquet(f"{self.root}/runs")
        return r.groupBy("request_id").agg(F.max_by(F.struct("status", "at", "error"), "step").alias("v"), F.max("query").alias("query")).select("request_id", "query", "v.*")
