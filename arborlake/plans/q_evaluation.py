"""Metrics over judged retrieval, packages and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, ranking, textgen
from .registry import query

_J = "j AS (SELECT label AS c, vec_id AS item FROM embeddings WHERE vec_id % 37 = 0), h AS (SELECT label AS c, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 20)"


def judged(t):
    v = t("embeddings").select(F.col("label").alias("c"), F.col("vec_id").alias("item"), F.get("embedding", F.lit(0)).alias("e"))
    hits = ranking.with_rank(v, F.desc("e"), F.col("item"), by=["c"]).where("rank <= 20")
    return v.where("item % 37 = 0").select("c", "item"), hits.select("c", "item", F.col("rank").cast("long").alias("rank"))


_CASE = f"WITH {_J} SELECT j.c, count(*) AS expected, count(rank) AS found, round(count(rank) / count(*), 6) AS recall, min(rank) AS first_rank, round(coalesce(1.0 / min(rank), 0), 6) AS reciprocal_rank, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (rank <= 8) / count(*), 6) AS recall_at_8 FROM j LEFT JOIN h ON j.c = h.c AND j.item = h.item GROUP BY 1"


@query("recall_per_case", _CASE)
def recall_per_case(t):
    return evaluation.per_case(*judged(t), "c", "item")


@query("recall_mrr", f"SELECT count(*) AS cases, round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mrr, round(count(*) FILTER (found > 0) / count(*), 6) AS hit_rate FROM ({_CASE})")
def recall_mrr(t):
    return evaluation.overall(evaluation.per_case(*judged(t), "c", "item"))


@query(
    "group_recall",
    f"WITH {_J}, g AS (SELECT j.c, j.item % 2 AS g, max(CASE WHEN h.item IS NULL THEN 0 ELSE 1 END) AS hit FROM j LEFT JOIN h ON j.c = h.c AND j.item = h.item GROUP BY 1, 2), k AS (SELECT c, sum(hit) AS hit, count(*) AS n FROM g GROUP BY 1) SELECT round(sum(hit) / sum(n), 6) AS group_recall, round(count(*) FILTER (hit = n) / count(*), 6) AS full_case_recall FROM k",
)
def group_recall(t):
    j, h = judged(t)
    return evaluation.group_recall(j.withColumn("g", F.col("item") % 2), h, "c", "g", "item")


@query("negative_no_match", "SELECT count(*) AS negatives, round(count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) / count(*), 6) AS no_match_rate FROM customer WHERE c_acctbal < 0")
def negative_no_match(t):
    hits = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return evaluation.negatives(t("customer").where("c_acctbal < 0").select("c_custkey"), hits, "c_custkey")


@query("score_separation", "SELECT round(avg(CASE WHEN quality = 1 THEN n_chars END) - avg(CASE WHEN quality <> 1 THEN n_chars END), 6) AS separation FROM documents JOIN labels USING (doc_id)")
def score_separation(t):
    d = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id")
    return evaluation.separation(d.withColumn("rel", F.col("quality") == 1), "rel", "n_chars")


@query(
    "strategy_matrix",
    f"""WITH {_J}, s AS (SELECT * FROM (VALUES ('flat', 1.0, 10), ('dense', 2.0, 60), ('steep', 1.0, 1)) s(strategy, w, k))
SELECT strategy, round(sum(w / (k + rank)), 6) AS gain, count(*) AS hits FROM s, j JOIN h ON j.c = h.c AND j.item = h.item GROUP BY 1""",
)
def strategy_matrix(t):
    j, h = judged(t)
    s = h.sparkSession.createDataFrame([("flat", 1.0, 10), ("dense", 2.0, 60), ("steep", 1.0, 1)], "strategy string, w double, k int")
    return j.join(h, ["c", "item"]).join(F.broadcast(s)).groupBy("strategy").agg(F.round(F.sum(F.col("w") / (F.col("k") + F.col("rank"))), 6).alias("gain"), F.count("*").alias("hits"))


@query("package_profiles", "SELECT role AS profile, count(*) AS packages, count(*) FILTER (ceil(strlen(text) / 4) <= 100) AS within, round(avg(CAST(ceil(strlen(text) / 4) AS BIGINT)), 4) AS mean_tokens, CAST(max(ceil(strlen(text) / 4)) AS BIGINT) AS max_tokens FROM conversations GROUP BY 1")
def package_profiles(t):
    p = t("conversations").select(F.col("role").alias("profile"), F.ceil(F.octet_length("text") / 4).cast("long").alias("tokens"), F.lit(100).alias("budget"))
    return evaluation.package_profiles(p)


@query("text_generation_scores")
def text_generation_scores(t):
    c = t("conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return textgen.scores(q.join(a, ["conv_id", "turn"]), ["conv_id", "turn"], "reference", "response")


@query("sentence_split")
def sentence_split(t):
    from ..operators.evidence import split_sentences

    return split_sentences(t("benchmark"), "item_id", "text")


@query("verified_quotes")
def verified_quotes(t):
    from ..operators.evidence import verify

    d = t("documents").select("doc_id", F.col("text").alias("page"), F.when(F.length("text") > 200, F.substring("text", 20, 90)).alias("quote"))
    return verify(d, ["doc_id"], "quote", "page")


_CHUNKS = """WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c(conv_id, i, turn, chunk, size, n) AS (SELECT conv_id, i, turn, 0, n, n FROM p WHERE i = 1 UNION ALL SELECT p.conv_id, p.i, p.turn, CASE WHEN c.size + p.n > 800 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.size + p.n > 800 THEN p.n ELSE c.size + p.n END, p.n FROM c JOIN p ON p.conv_id = c.conv_id AND p.i = c.i + 1)
SELECT conv_id, chunk, min(turn) AS first_page, max(turn) AS last_page, CAST(sum(n) AS BIGINT) AS chars FROM c GROUP BY 1, 2"""


@query("chunked_pages", _CHUNKS)
def chunked_pages(t):
    from ..operators.evidence import chunk_pages

    return chunk_pages(t("conversations"), "conv_id", "turn", "text", 800)


@query("context_packages")
def context_packages(t):
    from ..operators.context import pack_papers

    return pack_papers(t("conversations"), "conv_id", "turn", "text", 400)


@query("self_bleu")
def self_bleu(t):
    return textgen.self_bleu(t("conversations"), "conv_id", "text")


_REASONS = ["off_topic", "adopted", "transfer_risk", "coverage_gap", "already_covered", "strange_reason"]


def _feedback(t):
    k = F.col("event_id")
    names = F.array(*[F.lit(r) for r in _REASONS])
    return t("events").select(
        "event_id",
        F.concat(F.lit("f"), (k % 5000).cast("string")).alias("feedback_id"),
        F.when(k % 97 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("occurred_at"),
        F.lit("human").alias("source"),
        F.lit(None).cast("string").alias("workflow"),
        F.lit(None).cast("string").alias("run_id"),
        F.lit("review").alias("stage"),
        F.get(names, (k % 6).cast("int")).alias("reason"),
        F.when(k % 6 == 3, "topic").when(k % 6 == 1, "idea").when(k % 6 == 2, "idea").otherwise("paper").alias("kind"),
        F.concat(F.lit("p"), (k % 50).cast("string")).alias("paper_id"),
        F.when(k % 6 == 1, F.concat(F.lit("pt"), (k % 4).cast("string"))).alias("point_id"),
        F.lit("an idea").alias("idea_ref"),
        F.lit("a topic").alias("topic"),
        F.when(k % 12 != 3, F.array(F.lit("a query"))).alias("queries"),
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("string").alias("follow_up_of"),
        F.when(k % 7 == 0, F.concat(F.lit("r"), (k % 20).cast("string"))).alias("request_id"),
    )


# In the order of the batch: bad dates and gaps without queries are rejected, stored ids are duplicates, and of the rest the first delivered record of an id is accepted.
_ACK = """v AS (SELECT event_id, event_id % 5000 AS f, event_id % 97 <> 0 AND event_id % 12 <> 3 AS valid,
  event_id % 7 <> 0 OR (event_id % 20 < 15 AND event_id % 50 < 40 AND (event_id % 6 <> 1 OR event_id % 4 < 2)) AS delivered FROM events),
w AS (SELECT *, min(event_id) FILTER (valid AND delivered) OVER (PARTITION BY f) AS first FROM v),
a AS (SELECT event_id, CASE WHEN NOT valid THEN 'rejected' WHEN f < 100 THEN 'duplicate' WHEN event_id = first THEN 'accepted' WHEN event_id > first THEN 'duplicate' ELSE 'rejected' END AS status FROM w)"""


def _acknowledged(t):
    from ..operators.feedback import acknowledge

    spark = t("region").sparkSession
    stored = t("events").where("event_id < 100").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("feedback_id"))
    # 15 archived responses of 40 papers with two points each.
    outputs = spark.range(15 * 40).select(F.concat(F.lit("r"), (F.col("id") % 15).cast("string")).alias("request_id"), F.concat(F.lit("p"), F.floor(F.col("id") / 15).cast("string")).alias("paper_id"), F.array(F.lit("pt0"), F.lit("pt1")).alias("point_ids"))
    return acknowledge(_feedback(t), stored, outputs, "event_id")


@query("feedback_ack", f"WITH {_ACK} SELECT status, count(*) AS n FROM a GROUP BY 1")
def feedback_ack(t):
    return _acknowledged(t).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "feedback_summary",
    f"WITH {_ACK} SELECT count(*) AS received, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'rejected') AS errors, list_sort(list(DISTINCT CASE WHEN event_id % 6 = 5 THEN 'strange_reason' END) FILTER (status <> 'rejected' AND event_id % 6 = 5)) AS unknown_reasons, list_sort(list(DISTINCT 'p' || event_id % 50) FILTER (status <> 'rejected' AND event_id % 50 >= 45)) AS unresolved_papers FROM a",
)
def feedback_summary(t):
    from ..operators.feedback import acknowledgement

    a = _acknowledged(t)
    papers = t("region").sparkSession.range(45).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("paper_id"))
    return acknowledgement(a, papers)


@query(
    "reason_rollup",
    "SELECT ['off_topic', 'adopted', 'transfer_risk', 'coverage_gap', 'already_covered', 'strange_reason'][event_id % 6 + 1] AS reason, ['retrieval_defect', 'positive', 'project_relative', 'corpus_demand', 'redundancy', 'unknown'][event_id % 6 + 1] AS reason_group, ['corpus_review', 'corpus_review', 'project_only', 'corpus_review', 'project_only', 'corpus_review'][event_id % 6 + 1] AS signal_scope, count(*) AS n FROM events GROUP BY 1, 2, 3",
)
def reason_rollup(t):
    from ..operators.feedback import rollup

    return rollup(_feedback(t))


@query("curated_search")
def curated_search(t):
    from ..operators.curated import curated_search as search
    from .q_retrieval import dense, sparse

    def evidence(n):
        hits = sparse(t).limit(n)
        return hits.select("doc_id", F.col("doc_id").alias("point"), F.lit("evidence").alias("kind"), F.array(F.col("doc_id").cast("string")).alias("evidence_ids"), (F.col("score") / (F.col("score") + 10)).alias("relevance"), "rank")

    def discovery(n):
        return dense(t).limit(n).select("doc_id", F.greatest(F.lit(0.0), "score").alias("relevance"), "rank")

    published = F.timestamp_seconds(F.lit(1_500_000_000) + F.col("doc_id") * 86_400)
    meta = t("documents").select("doc_id", "lang", published.alias("published"))
    return search(evidence, discovery, meta, "doc_id", 10, "2021-01-01").select("doc_id", "final_rank", "relevance", "tier", "items")
