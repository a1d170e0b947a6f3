"""Dense, sparse and hybrid retrieval, fusion and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..operators import ranking, vector
from . import stored
from .q_text import SQL_TOKENS
from .registry import query

K, DENSE_W, SPARSE_W, CANDIDATES = 60, 1.1, 1.0, 50

SQL_SPARSE = f"""
w AS (SELECT doc_id, token, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, unnest({SQL_TOKENS}) AS token FROM documents) GROUP BY 1, 2),
q AS (SELECT token, 1 + ln(count(*)) AS tf FROM (SELECT unnest({SQL_TOKENS}) AS token FROM benchmark WHERE item_id = 3) GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT token, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM w, n GROUP BY token),
sp AS (SELECT w.doc_id, round(sum(q.tf * w.tf * i.idf), 6) AS score FROM q JOIN w USING (token) JOIN i USING (token) GROUP BY 1),
sr AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sp QUALIFY rank <= 50)"""
SQL_DENSE = """
ds AS (SELECT e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings v WHERE v.vec_id = 7),
dr AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 50)"""
SQL_FUSED = "fu AS (SELECT doc_id, round(sum(p), 9) AS rrf FROM (SELECT doc_id, 1.1 / (60 + rank) AS p FROM dr UNION ALL SELECT doc_id, 1.0 / (60 + rank) FROM sr) GROUP BY 1)"


def sparse(t):
    index = stored.postings(t)
    terms = index.query_terms(t("benchmark").where("item_id = 3"), "item_id", "text")
    top = index.top(terms, CANDIDATES).withColumnRenamed("doc", "doc_id")
    return ranking.with_rank(top, F.desc("score"), F.col("doc_id")).select("doc_id", "score", "rank")


def dense(t):
    v = t("embeddings")
    q = F.broadcast(v.where("vec_id = 7").select(F.col("embedding").alias("q")))
    scored = v.join(q).select(F.col("vec_id").alias("doc_id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "doc_id").limit(CANDIDATES)
    return ranking.with_rank(top, F.desc("score"), F.col("doc_id"))


def fused(t):
    return ranking.rrf([(dense(t), DENSE_W), (sparse(t), SPARSE_W)], "doc_id", K).withColumn("rrf", F.round("rrf", 9))


@query("hybrid_rrf_topk", f"WITH {SQL_SPARSE}, {SQL_DENSE}, {SQL_FUSED} SELECT doc_id, rrf FROM fu ORDER BY rrf DESC, doc_id LIMIT 20")
def hybrid_rrf_topk(t):
    return fused(t).orderBy(F.desc("rrf"), "doc_id").limit(20)


@query("sparse_topk", f"WITH {SQL_SPARSE} SELECT doc_id, score, rank FROM sr")
def sparse_topk(t):
    return sparse(t)


@query("knn_cosine", f"WITH {SQL_DENSE} SELECT doc_id, score, rank FROM dr WHERE rank <= 20")
def knn_cosine(t):
    return dense(t).where("rank <= 20")


@query(
    "knn_many",
    "SELECT q AS query_id, vec_id, score, rank FROM (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0) WHERE rank <= 5",
)
def knn_many(t):
    v = t("embeddings")
    q = v.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn_blocks(q, v.select("vec_id", "embedding"), "query_id", "vec_id", "embedding", 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    "related_papers",
    "SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 42 AND b.vec_id <> 42 ORDER BY score DESC, b.vec_id LIMIT 10",
)
def related_papers(t):
    v = t("embeddings")
    q = F.broadcast(v.where("vec_id = 42").select(F.col("embedding").alias("q")))
    return v.where("vec_id <> 42").join(q).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(
    "recommendation",
    "WITH s AS (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (1, 2, 3)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rn FROM s) SELECT vec_id, max(score) AS score FROM r WHERE rn <= 3 GROUP BY 1 ORDER BY score DESC, vec_id LIMIT 5",
)
def recommendation(t):
    v = t("embeddings")
    q = v.where("vec_id in (1, 2, 3)").select(F.col("vec_id").alias("interest"), "embedding")
    hits = vector.knn(q, v, "interest", "vec_id", "embedding", 3)
    return hits.groupBy("vec_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "vec_id").limit(5)


@query("relevance_calibrated", f"WITH {SQL_SPARSE}, {SQL_DENSE}, {SQL_FUSED} SELECT doc_id, round(greatest(0, least(1, (rrf - 1.1 / 61) / (2.1 / 61 - 1.1 / 61))), 5) AS relevance FROM fu")
def relevance_calibrated(t):
    return fused(t).select("doc_id", F.round(ranking.rrf_relevance(F.col("rrf"), [DENSE_W, SPARSE_W], K), 5).alias("relevance"))


@query(
    "diversity_rerank",
    """WITH d AS (SELECT doc_id, source, n_chars::DOUBLE AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents QUALIFY position <= 200),
k AS (SELECT *, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) - 0.2 * (row_number() OVER (PARTITION BY source ORDER BY score DESC, position) - 1), 9) AS key FROM d)
SELECT doc_id, row_number() OVER (ORDER BY key DESC, position) AS new_rank FROM k""",
)
def diversity_rerank(t):
    top = t("documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(200)
    top = ranking.with_rank(top, F.desc("score"), F.col("doc_id"), name="position")
    return ranking.diversity(top, "source", "score", 0.2).select("doc_id", F.col("new_rank").cast("long").alias("new_rank"))


_FUSION = "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS ra, n_chars / 40000.0 AS rel FROM documents QUALIFY ra <= 60), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rb, 0.5 AS rel FROM embeddings QUALIFY rb <= 60)"


def _two_sources(t):
    a = ranking.with_rank(t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(60), F.desc("n_chars"), F.col("doc_id"), name="ra")
    b = ranking.with_rank(t("embeddings").orderBy(F.desc(F.get("embedding", F.lit(0))), "vec_id").limit(60), F.desc(F.get("embedding", F.lit(0))), F.col("vec_id"), name="rb")
    a = a.select("doc_id", "ra", (F.col("n_chars") / 40000.0).alias("rel_a"))
    b = b.select(F.col("vec_id").alias("doc_id"), "rb", F.lit(0.5).alias("rel_b"))
    return a.join(b, "doc_id", "full_outer")


@query(
    "paper_fusion",
    f"{_FUSION} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round((coalesce(1.2 * (0.25 + 0.75 * a.rel) / (60 + ra), 0) + coalesce(1.0 * (0.25 + 0.75 * b.rel) / (60 + rb), 0)) / (2.2 / 61), 6) AS relevance FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id",
)
def paper_fusion(t):
    rel = ranking.paper_relevance([("ra", "rel_a", 1.2), ("rb", "rel_b", 1.0)], 60)
    return _two_sources(t).select("doc_id", F.round(rel, 6).alias("relevance"))


@query(
    "recency_blend",
    "SELECT o_orderkey, round(0.8 * (o_totalprice / 500000) + 0.2 * pow(0.5, greatest(0, epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400.0 / 365.0), 5) AS relevance FROM orders",
)
def recency_blend(t):
    rel = ranking.recency(F.col("o_totalprice") / 500000, F.col("o_orderdate"), F.lit("2000-01-01").cast("timestamp"), 365.0, 0.2)
    return t("orders").select("o_orderkey", F.round(rel, 5).alias("relevance"))


@query(
    "curated_items",
    """WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag AS kind, CAST(l_suppkey % 3 AS VARCHAR) || ',' || CAST(9 AS VARCHAR) AS ev, l_extendedprice AS rel FROM lineitem),
d AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey, ev ORDER BY rel DESC, l_linenumber) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY rel DESC, l_linenumber) AS kn FROM d)
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN kn = 1 THEN 0 ELSE 1 END, rel DESC, l_linenumber) AS item_rank FROM k QUALIFY item_rank <= 3""",
)
def curated_items(t):
    i = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), F.array((F.col("l_suppkey") % 3).cast("string"), F.lit("9")).alias("ev"), F.col("l_extendedprice").alias("rel"))
    out = ranking.curate(i, "l_orderkey", "kind", F.col("ev"), "rel", "l_linenumber", 3)
    return out.select("l_orderkey", "l_linenumber", F.col("item_rank").cast("long").alias("item_rank"))


@query(
    "final_order",
    f"{_FUSION} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, row_number() OVER (ORDER BY round(coalesce(a.rel, 0), 6) DESC, CASE WHEN a.doc_id IS NOT NULL THEN 1 ELSE 0 END DESC, coalesce(b.rel, 0) DESC, coalesce(a.doc_id, b.doc_id) DESC) AS final_rank FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id",
)
def final_order(t):
    j = _two_sources(t)
    order = [F.desc(F.round(F.coalesce("rel_a", F.lit(0.0)), 6)), F.desc(F.when(F.col("ra").isNotNull(), 1).otherwise(0)), F.desc(F.coalesce("rel_b", F.lit(0.0))), F.desc("doc_id")]
    return ranking.with_rank(j, *order, name="final_rank").select("doc_id", F.col("final_rank").cast("long").alias("final_rank"))


@query(
    "unique_paper_rank",
    "SELECT source, row_number() OVER (ORDER BY first) AS paper_rank FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY 1)",
)
def unique_paper_rank(t):
    first = t("documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return ranking.with_rank(first, F.col("first"), name="paper_rank").select("source", F.col("paper_rank").cast("long").alias("paper_rank"))


_CENT = "WITH c AS (SELECT label, list(a ORDER BY i) AS centroid FROM (SELECT label, i, avg(v) AS a FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1), s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s FROM embeddings, c)"


@query("centroid_assign", f"{_CENT} SELECT vec_id, arg_max(label, round(s, 6) - label * 1e-9) AS assigned, max(round(s, 6)) AS similarity FROM s GROUP BY 1")
def centroid_assign(t):
    v = t("embeddings")
    return vector.assign(v, vector.centroids(v, "label", "embedding", 64), "vec_id", "embedding", "label")


@query("doc_topic_matrix", f"{_CENT} SELECT vec_id, label, round(greatest(0, s) / sum(greatest(0, s)) OVER (PARTITION BY vec_id), 6) AS share FROM s")
def doc_topic_matrix(t):
    v = t("embeddings")
    return vector.topic_matrix(v, vector.centroids(v, "label", "embedding", 64), "vec_id", "embedding", "label")


@query("vector_dimensions", "SELECT count(*) AS vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(*) FILTER (len(embedding) = 0) AS empty, min(len(embedding)) = max(len(embedding)) AND count(*) FILTER (len(embedding) = 0) = 0 AS consistent FROM embeddings")
def vector_dimensions(t):
    return vector.dimension_report(t("embeddings"), "embedding")


@query("topic_word_matrix", "SELECT source, count(*) FILTER (w = 'the') AS the, count(*) FILTER (w = 'der') AS der, count(*) FILTER (w = 'que') AS que FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1")
def topic_word_matrix(t):
    w = t("documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.groupBy("source").pivot("w", ["the", "der", "que"]).count().na.fill(0)


@query("topic_word_counts", "SELECT source, w, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1, 2")
def topic_word_counts(t):
    w = t("documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.groupBy("source", "w").agg(F.count("*").alias("n"))


@query("kmeans_clusters")
def kmeans_clusters(t):
    return vector.kmeans(t("embeddings"), "vec_id", "embedding", 8)


@query("projection_2d")
def projection_2d(t):
    return vector.project_2d(t("embeddings"), "vec_id", "embedding")


@query("bounded_picks", "SELECT doc_id, lang, n_chars, lang AS picked_for FROM documents WHERE lang IN ('en', 'de', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 20")
def bounded_picks(t):
    return ranking.bounded_picks(t("documents").select("doc_id", "lang", "n_chars"), ["en", "de", "fr"], F.col("lang"), "doc_id", [F.desc("n_chars"), F.col("doc_id")], 20)
