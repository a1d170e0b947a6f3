"""Search over the stored indexes: filter, dense and sparse retrieval, fusion, calibration, threshold, coverage, reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .curated import candidate_limit
from .postings import PostingsIndex
from .vector_index import VectorIndex

DENSE_WEIGHT, SPARSE_WEIGHT, RRF_K = 1.1, 1.0, 60


@dataclass
class Search:
    """hits (key, relevance, rank, ...) and a status row."""

    hits: DataFrame
    status: DataFrame


def research_search(
    index: VectorIndex,
    query_vector,
    limit: int = 8,
    postings: PostingsIndex | None = None,
    terms: dict[str, float] | None = None,
    where: Column | None = None,
    min_relevance: float = 0.0,
    minimum: int = 50,
    exact: bool = True,
    weights: tuple[float, float] = (DENSE_WEIGHT, SPARSE_WEIGHT),
    k: int = RRF_K,
) -> Search:
    """One search: hybrid with postings and terms, else dense alone.

    where is a condition on the index's key and payload and holds for both
    retrievers. Relevance is the calibrated fused score (hybrid) or the cosine
    floored at 0. The status row counts what the filter leaves, candidates,
    and hits, and says why there are none: nothing passes the filter, no
    candidate, or none of at least min_relevance, with the best there was.
    """
    if not 0 <= min_relevance <= 1:
        raise ValueError("min_relevance lies between 0 and 1")
    n, key = candidate_limit(limit, minimum), index.key
    eligible = index.vectors().where(F.lit(True) if where is None else where).select(F.col(key).alias("doc"))
    dense = index.search(query_vector, n, where=where, exact=exact).select(F.col(key).alias("doc"), "score", "rank")
    if postings is None:
        fused = dense.select("doc", F.round(F.greatest("score", F.lit(0.0)), 6).alias("relevance"))
    else:
        sparse = postings.top(terms or {}, n, within=None if where is None else eligible)
        sparse = sparse.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))
        both = ranking.rrf([(dense, weights[0]), (sparse, weights[1])], "doc", k)
        fused = both.select("doc", F.round(ranking.rrf_relevance(F.col("rrf"), list(weights), k), 6).alias("relevance"), "rrf")
    order = [F.desc("relevance"), *([F.desc(F.round("rrf", 9))] if postings is not None else []), F.col("doc")]
    kept = ranking.with_rank(fused.where(F.col("relevance") >= min_relevance).orderBy(*order).limit(limit), *order)
    hits = kept.select(F.col("doc").alias(key), "relevance", "rank")
    counts = fused.agg(F.count("*").alias("candidates"), F.coalesce(F.max("relevance"), F.lit(0.0)).alias("top_relevance"), F.count_if(F.col("relevance") >= min_relevance).alias("enough"))
    status = eligible.agg(F.count("*").alias("eligible")).join(F.broadcast(counts))
    reason = (
        F.when(F.col("enough") > 0, F.lit(None).cast("string"))
        .when(F.col("eligible") == 0, F.lit("nothing passes the filter"))
        .when(F.col("candidates") == 0, F.lit("no candidate was found"))
        .otherwise(F.concat(F.lit(f"no candidate reached {min_relevance:.3f}; the best had "), F.format_number("top_relevance", 3)))
    )
    status = status.select(
        "eligible", "candidates", F.least("enough", F.lit(limit)).cast("long").alias("returned"), F.round("top_relevance", 6).alias("top_relevance"), F.when(F.col("enough") > 0, "matches").otherwise("no_match").alias("result_status"), reason.alias("no_match_reason")
    )
    return Search(hits, status)


def semantic_search(index: VectorIndex, query_vector, metadata: DataFrame, key: str, limit: int = 10, exact: bool = True) -> DataFrame:
    """(key, score, rank, metadata...): the most similar vectors with what is known of them; hits without metadata stay."""
    top = index.search(query_vector, limit, exact=exact).select(F.col(index.key).alias(key), "score", "rank")
    return F.broadcast(top).join(metadata, key, "left")
