"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from .registry import query


@query("eligible_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def eligible_semi(t):
    big = t("orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(
    "hydrate_outer",
    """WITH a AS (SELECT doc_id AS k, lang AS kind, source FROM documents), b AS (SELECT vec_id * 3 AS k, CAST(label AS VARCHAR) AS kind, '' AS source FROM embeddings)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.kind, b.kind) AS kind, coalesce(nullif(trim(b.source), ''), a.source) AS source, array_to_string(list_concat(CASE WHEN a.k IS NULL THEN [] ELSE ['corpus'] END, CASE WHEN b.k IS NULL THEN [] ELSE ['vectors'] END), '+') AS sources FROM a FULL OUTER JOIN b ON a.k = b.k""",
)
def hydrate_outer(t):
    a = t("documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("kind"), "source")
    b = t("embeddings").select((F.col("vec_id") * 3).alias("k"), F.col("label").cast("string").alias("kind"), F.lit("").alias("source"))
    out = joins.hydrate_outer(a, b, "k", {"kind": True, "source": False}, ("corpus", "vectors"))
    return out.withColumn("sources", F.array_join("sources", "+"))


@query("hydrate_left", "SELECT v.vec_id, v.label, d.lang, d.source FROM embeddings v LEFT JOIN documents d ON v.vec_id = d.doc_id AND d.n_chars > 500")
def hydrate_left(t):
    meta = t("documents").where("n_chars > 500").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return joins.hydrate(t("embeddings").select("vec_id", "label"), meta, "vec_id", ["lang", "source"])


@query("pending_anti", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber)")
def pending_anti(t):
    li = t("lineitem")
    return joins.pending(li.select("l_orderkey", "l_linenumber"), li.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"])


@query("dangling_evidence", "SELECT DISTINCT o_orderkey, o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_evidence(t):
    items = t("orders").select("o_orderkey", F.array("o_custkey").alias("ids"))
    return joins.dangling(items, "o_orderkey", "ids", t("customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", "c_custkey")


@query(
    "source_resolution",
    "SELECT k, array_to_string(list_filter([CASE WHEN k IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN 'documents' END, CASE WHEN k IN (SELECT doc_id FROM labels) THEN 'labels' END, CASE WHEN k IN (SELECT page_id FROM pages) THEN 'pages' END], lambda x: x IS NOT NULL), ',') AS sources FROM (SELECT vec_id AS k FROM embeddings)",
)
def source_resolution(t):
    ids = t("embeddings").select(F.col("vec_id").alias("k"))
    tables = [("documents", t("documents").where("lang = 'en'").select(F.col("doc_id").alias("k"))), ("labels", t("labels").select(F.col("doc_id").alias("k"))), ("pages", t("pages").select(F.col("page_id").alias("k")))]
    return joins.resolved_sources(ids, "k", tables).withColumn("sources", F.array_join("sources", ","))


@query("three_way_left", "SELECT s.s_suppkey, n.n_name, r.r_name, coalesce(l.n, 0) AS n_lines FROM supplier s LEFT JOIN nation n ON s_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) l ON l.l_suppkey = s.s_suppkey")
def three_way_left(t):
    lines = t("lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    out = t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey"), "left").join(t("region"), F.expr("n_regionkey = r_regionkey"), "left").join(lines, "s_suppkey", "left")
    return out.select("s_suppkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("membership_flag", "SELECT p.page_id, l.doc_id IS NOT NULL AS labelled FROM pages p LEFT JOIN labels l ON p.page_id = l.doc_id")
def membership_flag(t):
    flags = t("labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("f"))
    return t("pages").select("page_id").join(flags, "page_id", "left").select("page_id", F.col("f").isNotNull().alias("labelled"))


@query("newest_context", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def newest_context(t):
    return joins.newest_per(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey")).drop("o_orderdate")


@query("replaced_by_lookup", "SELECT l.l_orderkey, l.l_linenumber, m.v AS replaced_by FROM lineitem l JOIN (SELECT l_orderkey, max(l_linenumber) AS v FROM lineitem GROUP BY 1) m ON l.l_orderkey = m.l_orderkey WHERE l.l_linenumber < m.v")
def replaced_by_lookup(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber")
    return li.join(li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("replaced_by")), "l_orderkey").where("l_linenumber < replaced_by")


@query("target_check", "SELECT c.conv_id, c.turn, CASE WHEN d.doc_id IS NULL THEN 'unknown paper' WHEN d.lang <> 'en' THEN 'wrong language' ELSE 'ok' END AS verdict FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 7")
def target_check(t):
    d = t("documents").select("doc_id", "lang")
    j = t("conversations").select("conv_id", "turn").join(d, F.expr("doc_id = conv_id * 7"), "left")
    return j.select("conv_id", "turn", F.when(F.col("doc_id").isNull(), "unknown paper").when(F.col("lang") != "en", "wrong language").otherwise("ok").alias("verdict"))


@query("exact_five_keys", "SELECT count(*) AS n FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_discount > 0.05 AND a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber AND a.l_returnflag = b.l_returnflag)")
def exact_five_keys(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    li = t("lineitem")
    return li.join(li.where("l_discount > 0.05").select(*keys), keys, "left_semi").agg(F.count("*").alias("n"))


@query("attached_quotes", "SELECT conv_id, count(*) AS n_turns, string_agg(left(text, 12), '|' ORDER BY turn) AS quotes FROM conversations GROUP BY 1")
def attached_quotes(t):
    ev = F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 12).alias("q"))))
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(ev, lambda x: x["q"]), "|").alias("quotes"))
