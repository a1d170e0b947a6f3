"""Reports: distributions, topics, suites and curated metrics, selections, packages, id lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, ranking, suites, topics
from .registry import query


@query(
    "distribution_report",
    "WITH c AS (SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders GROUP BY 1) SELECT period, n, round(100 * n / sum(n) OVER (), 6) AS percent, CAST(floor(n * 40 / max(n) OVER ()) AS INTEGER) AS bar FROM c",
)
def distribution_report(t):
    from ..operators.ranking import distribution

    return distribution(t("orders").select(F.date_format("o_orderdate", "yyyy").alias("period")), "period").withColumn("bar", F.length("bar"))


def _assigned(t):
    return t("embeddings").select("vec_id", F.col("label").alias("topic"), F.round(F.abs(F.get("embedding", F.lit(0)).cast("double")), 6).alias("probability"))


@query("topic_report", "WITH a AS (SELECT label AS topic, round(abs(embedding[1]::DOUBLE), 6) AS p FROM embeddings) SELECT CASE WHEN p >= 0.5 THEN topic ELSE -1 END AS topic, count(*) AS n, round(avg(p), 6) AS mean_probability FROM a GROUP BY 1")
def topic_report(t):
    return topics.report(_assigned(t), 0.5)


@query("topic_confidence", "WITH a AS (SELECT round(abs(embedding[1]::DOUBLE), 6) AS p FROM embeddings) SELECT round(avg(p), 6) AS mean_probability, round(count(*) FILTER (p > 0.5) / count(*), 6) AS confident FROM a")
def topic_confidence(t):
    words = t("embeddings").select(F.col("label").alias("topic"), F.col("vec_id").cast("string").alias("token"))
    return topics.quality(_assigned(t), words).drop("coherence")


@query(
    "class_weights",
    "WITH w AS (SELECT label AS topic, unnest(string_split(p_type || ' ' || p_brand, ' ')) AS token FROM (SELECT p_partkey % 5 AS label, p_type, p_brand FROM part)), n AS (SELECT topic, token, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT topic, sum(n) AS size FROM n GROUP BY 1), f AS (SELECT token, sum(n) AS f FROM n GROUP BY 1) SELECT n.topic, n.token, round(n / size * ln(1 + (SELECT avg(size) FROM s) / f), 9) AS weight FROM n JOIN s USING (topic) JOIN f USING (token)",
)
def class_weights(t):
    return topics.class_weights(t("part").select((F.col("p_partkey") % 5).alias("topic"), F.explode(F.array("p_type", "p_brand")).alias("token"))).withColumn("weight", F.round("weight", 9))


@query(
    "primary_topics",
    "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS topic, CAST(CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS probability, CAST(CASE vec_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 0.4 END AS DOUBLE) AS mean FROM embeddings",
)
def primary_topics(t):
    k = F.col("vec_id") % 3
    of = F.when(k == 1, F.array("label")).when(k == 2, F.array("label", F.lit(7))).otherwise(F.array().cast("array<int>"))
    p = F.when(k == 1, F.array(F.lit(0.5))).when(k == 2, F.array(F.lit(0.5), F.lit(0.3))).otherwise(F.array().cast("array<double>"))
    return t("embeddings").select("vec_id", topics.primary(of, p).alias("x")).select("vec_id", "x.topic", "x.probability", "x.mean")


@query("topic_documents")
def topic_documents(t):
    docs = t("documents").select("doc_id", "text")
    return topics.classify(docs, "doc_id", "text", topics.fit(docs, "doc_id", "text", 8))


@query("hashed_embeddings")
def hashed_embeddings(t):
    from ..operators.models import embed

    return embed(t("documents"), "doc_id", "text", prefix="search_document: ")


@query("token_indices", "SELECT count(DISTINCT token) AS tokens FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part)")
def token_indices(t):
    from ..functions.text import token_hash

    words = t("part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return token_hash(words, "token").agg(F.countDistinct("index").alias("tokens"))


@query(
    "attached_evidence",
    "SELECT o_orderkey, CAST(count(l_linenumber) AS BIGINT) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC), '') AS pages FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3) ON l_orderkey = o_orderkey GROUP BY 1",
)
def attached_evidence(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    quotes = lines.where("l_linenumber <= 3").select(name.alias("id"), F.col("l_linenumber").alias("page"))
    # Each order cites all seven numbers, backwards.
    items = t("orders").select("o_orderkey", F.transform(F.sequence(F.lit(7), F.lit(1)), lambda p: F.concat_ws(":", F.col("o_orderkey").cast("string"), p.cast("string"))).alias("ids"))
    out = joins.attach_quotes(items, "o_orderkey", "ids", quotes, "id", ["page"])
    return out.select("o_orderkey", F.size("quotes").cast("long").alias("n"), F.array_join(F.transform("quotes", lambda q: q["page"].cast("string")), ",").alias("pages"))


@query(
    "paper_contexts",
    "SELECT coalesce(c_custkey, o_custkey) AS k, c_custkey IS NOT NULL AS known, o AS newest FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) FULL OUTER JOIN (SELECT o_custkey, max(o_orderkey) AS o FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
def paper_contexts(t):
    newest = joins.newest_per(t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", F.col("o_orderkey"))
    out = joins.with_context(t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), newest, "k")
    return out.select("k", "known", F.col("context.o_orderkey").alias("newest"))


@query("current_of_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def current_of_ids(t):
    a = t("orders").withColumn("is_current", F.col("o_orderstatus") == "O")
    return joins.current_of(a, t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", 30, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_custkey")


@query("selection_counts", "SELECT coalesce(lang, 'none') AS category, count(*) AS n FROM (SELECT lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100) GROUP BY 1")
def selection_counts(t):
    top = t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return top.groupBy(F.coalesce("lang", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


_CASES = """WITH r AS (SELECT o_custkey AS c, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
x AS (SELECT c, count(*) = count(DISTINCT p) AS dist, min(CASE WHEN p = '1-URGENT' THEN k END) AS pos FROM r GROUP BY 1),
j AS (SELECT c_custkey % 3 <> 0 AS judged, x.c IS NOT NULL AS hit, coalesce(dist, true) AS dist, pos FROM customer LEFT JOIN x ON x.c = c_custkey)"""


@query(
    "curated_metrics",
    f"{_CASES} SELECT count(*) AS cases, round(avg(CASE WHEN judged THEN CASE WHEN pos IS NULL THEN 0 ELSE 1 END END), 6) AS mean_recall, round(avg(CASE WHEN judged THEN coalesce(1 / pos, 0) END), 6) AS mrr, round(avg(CASE WHEN NOT judged THEN CASE WHEN hit THEN 0 ELSE 1 END END), 6) AS negative_pass_rate, round(avg(CASE WHEN dist THEN 1 ELSE 0 END), 6) AS duplicate_free_rate, 1.0::DOUBLE AS tier_rate, 1.0::DOUBLE AS budget_rate FROM j",
)
def curated_metrics(t):
    k = F.col("c_custkey")
    cases = t("customer").select(k.alias("case_id"), F.when(k % 3 != 0, F.array(F.lit("1-URGENT"))).otherwise(F.array().cast("array<string>")).alias("expected"))
    ranked = ranking.with_rank(t("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("paper_id"), "o_orderkey"), F.col("o_orderkey"), by=["case_id"])
    returned = ranked.select("case_id", "paper_id", "rank", F.lit("metadata_only").alias("tier"), F.lit(0).alias("items"), F.lit(10).alias("tokens"), F.lit(20).alias("budget"))
    return suites.curated_metrics(cases, returned)


@query(
    "evidence_owners",
    "SELECT o_orderkey AS case_id, 'e' || o_orderkey AS evidence_id, CASE WHEN o_orderkey % 10 = 0 THEN 'unknown evidence' WHEN o_orderkey % 10 = 1 THEN 'evidence of another paper' ELSE 'document has changed' END AS error FROM orders WHERE o_orderkey % 10 IN (0, 1, 2)",
)
def evidence_owners(t):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("e"), k.cast("string"))
    cases = t("orders").select(k.alias("case_id"), F.when(k % 10 == 1, -k).when(k % 10 != 3, k).alias("paper_id"), name.alias("evidence_id"))
    owners = t("orders").where("o_orderkey % 10 <> 0").select(name.alias("evidence_id"), k.alias("paper_id"), F.when(k % 10 == 2, "new").otherwise("old").alias("document_hash"))
    return suites.owner_errors(cases, owners, t("orders").select(k.alias("paper_id"), F.lit("old").alias("document_hash")))


@query(
    "fallback_metadata",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type ELSE CAST(p_partkey AS VARCHAR) END AS title, CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type] ELSE [] END AS authors, 'https://arxiv.org/abs/' || p_partkey AS abs_url FROM part",
)
def fallback_metadata(t):
    from ..operators.curated import fallback_metadata as fallback

    k = F.col("p_partkey")
    hits = t("part").select(
        k, F.when(k % 3 == 0, F.col("p_name")).alias("evidence_title"), F.when(k % 3 != 2, F.col("p_type")).alias("discovery_title"), F.lit(None).cast("string").alias("abstract"),
        F.when(k % 2 == 0, F.concat_ws(" and ", "p_brand", "p_type")).alias("authors"), F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("update_date"),
    )
    return fallback(hits, "p_partkey").select("p_partkey", "title", "authors", "abs_url")
