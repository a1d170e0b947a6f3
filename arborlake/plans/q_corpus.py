"""Filters, policies, versions and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import array_literal, category_tokens, prefix_year
from ..operators import corpus, versions
from .registry import query

SQL_CODES = "string_split(concat_ws(' ', lang, source), ' ')"


def codes():
    return F.split(F.concat_ws(" ", "lang", "source"), " ")


POLICY = corpus.RetentionPolicy(["en", "src3"], "any")


@query("category_any", f"SELECT doc_id FROM documents WHERE list_has_any({SQL_CODES}, ['fr', 'src3'])")
def category_any(t):
    return t("documents").where(F.arrays_overlap(codes(), array_literal(["fr", "src3"]))).select("doc_id")


@query("category_all", f"SELECT doc_id FROM documents WHERE list_has_all({SQL_CODES}, ['en', 'src3'])")
def category_all(t):
    policy = corpus.RetentionPolicy(["en", "src3"], "all")
    return corpus.retain(t("documents"), policy, codes(), F.lit(None).cast("string")).select("doc_id")


@query("date_window", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-03-01' AND '1996-02-29'")
def date_window(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").where(day.between("1995-03-01", "1996-02-29")).select("o_orderkey")


@query("policy_violations", f"SELECT count(*) FILTER (NOT coalesce(list_has_any({SQL_CODES}, ['en', 'src3']), false)) AS violations FROM documents")
def policy_violations(t):
    return corpus.violations(t("documents"), POLICY, codes(), F.lit(None).cast("string"))


@query("missing_core", "SELECT count(*) FILTER (doc_id IS NULL) AS no_id, count(*) FILTER (text IS NULL OR text = '') AS no_text, count(*) FILTER (lang IS NULL OR lang = '') AS no_lang FROM documents")
def missing_core(t):
    return t("documents").agg(F.count_if(corpus.missing(F.col("doc_id"))).alias("no_id"), F.count_if(corpus.missing(F.col("text"))).alias("no_text"), F.count_if(corpus.missing(F.col("lang"))).alias("no_lang"))


@query("timestamp_window", "SELECT event_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-20T23:59:59Z'")
def timestamp_window(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t("events").where(iso.between("2024-01-05T00:00:00Z", "2024-01-20T23:59:59Z")).select("event_id", "event_type")


@query("point_filter", "SELECT doc_id, lang FROM documents WHERE source = 'src3' AND lang IN ('en', 'de')")
def point_filter(t):
    return t("documents").where(F.col("source") == "src3").where(F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query("discovery_filter", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['ECONOMY', 'PROMO']) AND p_size BETWEEN 10 AND 20")
def discovery_filter(t):
    return t("part").where(F.col("p_size").between(10, 20)).where(F.arrays_overlap(category_tokens(F.col("p_type")), array_literal(["ECONOMY", "PROMO"]))).select("p_partkey")


@query("array_contains_scalar", "SELECT count(*) AS n FROM part WHERE list_contains(string_split(p_type, ' '), 'SMALL')")
def array_contains_scalar(t):
    return t("part").where(F.array_contains(F.split("p_type", " "), "SMALL")).agg(F.count("*").alias("n"))


@query("exists_nonempty", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> '' AND n_chars < 100")
def exists_nonempty(t):
    return t("documents").where("n_chars < 100").where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id")


@query("case_insensitive_regex", "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)/EN/[0-9]+')")
def case_insensitive_regex(t):
    return t("pages").where(F.col("url").rlike("(?i)/EN/[0-9]+")).select("page_id")


@query(
    "computed_projection",
    "SELECT p_partkey, string_split(p_type, ' ')[1] AS first_code, string_split(p_type, ' ')[-1] AS last_code, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n_codes, try_cast(substr(p_name, 1, 4) AS INTEGER) AS name_year FROM part",
)
def computed_projection(t):
    codes = F.split("p_type", " ")
    return t("part").select("p_partkey", F.get(codes, F.lit(0)).alias("first_code"), F.try_element_at(codes, F.lit(-1)).alias("last_code"), F.size(codes).cast("long").alias("n_codes"), prefix_year(F.col("p_name")).alias("name_year"))


@query("json_projection", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def json_projection(t):
    return t("events").where("event_type = 'purchase'").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "guard_report",
    "SELECT count(*) AS total, count(*) FILTER (lang = 'fr') AS retained, round(count(*) FILTER (lang = 'fr') / count(*), 6) AS fraction, CASE WHEN count(*) FILTER (lang = 'fr') / count(*) > 0.3 THEN 'fraction above maximum' ELSE '' END AS errors FROM documents",
)
def guard_report(t):
    return corpus.guard(t("documents"), F.col("lang") == "fr", 0.01, 0.30)


@query(
    "latest_version",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(l_linenumber, -1) DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1",
)
def latest_version(t):
    cur, _ = versions.split_latest(t("lineitem"), ["l_orderkey"], F.coalesce("l_linenumber", F.lit(-1)).desc(), F.col("l_shipdate").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc())
    return cur.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "archived_versions",
    "SELECT l_orderkey, count(*) AS n_archived FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn > 1 GROUP BY l_orderkey",
)
def archived_versions(t):
    _, old = versions.split_latest(t("lineitem"), ["l_orderkey"], F.col("l_linenumber").desc(), F.col("l_shipdate").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc())
    return old.groupBy("l_orderkey").agg(F.count("*").alias("n_archived"))


_CURRENT = "SELECT l_orderkey, max(l_linenumber) AS v FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber <= 4 GROUP BY 1"
_INCOMING = "SELECT l_orderkey, max(l_linenumber) AS v FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_linenumber % 2 = 1 GROUP BY 1"


@query(
    "upsert_disposition",
    f"""WITH a AS ({_CURRENT}), b AS ({_INCOMING})
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.v AS current_version, b.v AS incoming_version,
  CASE WHEN b.v IS NULL THEN 'keep' WHEN a.v IS NULL THEN 'insert' WHEN b.v > a.v THEN 'update' WHEN b.v = a.v THEN 'merge' ELSE 'archive_incoming' END AS disposition
FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey""",
)
def upsert_disposition(t):
    li = t("lineitem")
    a = li.where("l_orderkey % 3 <> 0 and l_linenumber <= 4").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("v"))
    b = li.where("l_orderkey % 5 <> 0 and l_linenumber % 2 = 1").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("v"))
    return versions.disposition(a, b, ["l_orderkey"], "v")


@query("duplicate_ids", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(t):
    return t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "tracking_diff",
    """WITH a AS (SELECT o_orderkey, o_orderstatus AS d FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS d FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' WHEN a.d = b.d THEN 'unchanged' ELSE 'updated' END AS status FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def tracking_diff(t):
    o = t("orders")
    a = o.where("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("d"))
    b = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("d"))
    return versions.tracking_diff(a, b, ["o_orderkey"], "d")


@query(
    "reconcile",
    "SELECT DISTINCT o_custkey, 'backfill' AS action FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT DISTINCT o_custkey, 'delete' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
)
def reconcile(t):
    o = t("orders")
    return versions.reconcile(o.where("o_orderstatus = 'O'").select("o_custkey"), o.where("o_orderstatus = 'F'").select("o_custkey"), ["o_custkey"])


@query(
    "idempotent_append",
    "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click') EXCEPT SELECT user_id, event_type FROM events WHERE event_id < 3000",
)
def idempotent_append(t):
    e = t("events").select("event_id", "user_id", "event_type")
    return versions.append_new(e.where("event_id < 3000"), e.where("event_type in ('view', 'click')"), ["user_id", "event_type"]).select("user_id", "event_type")


@query(
    "current_flag",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1 AS is_current FROM lineitem",
)
def current_flag(t):
    return versions.current_flag(t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], F.col("l_shipdate").desc(), F.col("l_linenumber").desc()).drop("l_shipdate")


@query(
    "snapshot_identity",
    "WITH b AS (SELECT c_custkey // 1000 AS b, sha256(string_agg(CAST(c_custkey AS VARCHAR), chr(10) ORDER BY c_custkey)) AS d, count(*) AS n FROM (SELECT DISTINCT c_custkey FROM customer) GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS snapshot, CAST(sum(n) AS BIGINT) AS n FROM b",
)
def snapshot_identity(t):
    return corpus.snapshot_identity(t("customer"), "c_custkey", 1000)
