"""Counts, distributions, profiles, limits and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quantiles, ranking
from .registry import query


def _count_by(name: str, pattern: str, duck: str) -> None:
    @query(name, f"SELECT strftime(o_orderdate, '{duck}') AS period, count(*) AS n FROM orders GROUP BY 1")
    def counts(t):
        return t("orders").groupBy(F.date_format("o_orderdate", pattern).alias("period")).agg(F.count("*").alias("n"))


_count_by("counts_by_day", "yyyy-MM-dd", "%Y-%m-%d")
_count_by("counts_by_month", "yyyy-MM", "%Y-%m")
_count_by("counts_by_year", "yyyy", "%Y")


@query("weekday_counts", "SELECT CAST(d.d AS INTEGER) AS weekday, count(o_orderkey) AS n FROM range(7) d(d) LEFT JOIN orders ON isodow(o_orderdate) - 1 = d.d GROUP BY 1")
def weekday_counts(t):
    counts = t("orders").groupBy(F.weekday("o_orderdate").alias("weekday")).agg(F.count("*").alias("n"))
    days = counts.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return days.join(F.broadcast(counts), "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "ymd_grouping_sets",
    "SELECT y, m, d, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) GROUP BY GROUPING SETS ((y), (m), (d))",
)
def ymd_grouping_sets(t):
    d = t("orders").select(F.date_format("o_orderdate", "yyyy").alias("y"), F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    sets = [[F.col("y")], [F.col("m")], [F.col("d")]]
    return d.groupingSets(sets, "y", "m", "d").agg(F.count("*").alias("n"))


@query(
    "month_gaps",
    """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders WHERE month(o_orderdate) NOT IN (3, 7)),
e AS (SELECT unnest(generate_series((SELECT min(m) FROM m)::TIMESTAMP, (SELECT max(m) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m)
SELECT strftime(m, '%Y-%m') AS month FROM e WHERE m NOT IN (SELECT m FROM m)""",
)
def month_gaps(t):
    return ranking.month_gaps(t("orders").where(~F.month("o_orderdate").isin(3, 7)), "o_orderdate")


@query(
    "share_of_total",
    "SELECT y, n, round(100.0 * n / sum(n) OVER (), 4) AS pct, CAST(floor(n * 40 / max(n) OVER ()) AS BIGINT) AS bar FROM (SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders GROUP BY 1)",
)
def share_of_total(t):
    c = t("orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return c.select("y", "n", F.round(100.0 * F.col("n") / F.sum("n").over(every), 4).alias("pct"), F.floor(F.col("n") * 40 / F.max("n").over(every)).cast("long").alias("bar"))


@query("last_n_months", "SELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12) ORDER BY m")
def last_n_months(t):
    return t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.count("*").alias("n")).orderBy(F.desc("m")).limit(12).orderBy("m")


@query("top_categories", "SELECT c AS category, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS c FROM part) GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def top_categories(t):
    return t("part").select(F.explode(F.split("p_type", " ")).alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("distinct_elements", "SELECT count(DISTINCT c) AS n_categories, count(*) AS n_uses FROM (SELECT unnest(string_split(p_type, ' ')) AS c FROM part)")
def distinct_elements(t):
    return t("part").select(F.explode(F.split("p_type", " ")).alias("c")).agg(F.countDistinct("c").alias("n_categories"), F.count("*").alias("n_uses"))


@query("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice")


@query("page_with_total", "SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20")
def page_with_total(t):
    c = t("customer").where("c_mktsegment = 'BUILDING'")
    total = c.agg(F.count("*").alias("total"))
    return c.orderBy("c_custkey").limit(20).select("c_custkey", "c_name").join(F.broadcast(total))


@query("keyset_batch", "SELECT doc_id, lang FROM documents WHERE doc_id > 250 ORDER BY doc_id LIMIT 50")
def keyset_batch(t):
    return t("documents").where("doc_id > 250").orderBy("doc_id").limit(50).select("doc_id", "lang")


@query("latest_one", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_one(t):
    return t("events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "ts")


@query("union_distinct", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t):
    return t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).union(t("customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def intersection(t):
    return t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(t("customer").where("c_acctbal < 0").select("c_custkey"))


@query("difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def difference(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("concat_dedup_head", "SELECT k, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, src) AS rn FROM (SELECT o_custkey AS k, o_totalprice AS s, 1 AS src FROM orders UNION ALL SELECT c_custkey, c_acctbal, 2 FROM customer)) WHERE rn = 1 ORDER BY s DESC, k LIMIT 30")
def concat_dedup_head(t):
    a = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("s"), F.lit(1).alias("src"))
    b = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("s"), F.lit(2).alias("src"))
    best = a.unionByName(b).groupBy("k").agg(F.max("s").alias("s"))
    return best.orderBy(F.desc("s"), "k").limit(30)


@query("report_merge", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 0.0 FROM supplier WHERE s_suppkey % 2 <> 0")
def report_merge(t):
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    update = s.where("k % 2 = 0")
    stored = s.withColumn("v", F.lit(0.0))
    return stored.join(update.select("k"), "k", "left_anti").unionByName(update)


@query(
    "integrity_report",
    "SELECT count(*) AS total, count(*) - count(DISTINCT o_orderkey) AS duplicate_ids, count(*) FILTER (o_orderdate IS NULL) AS no_date, count(*) FILTER (o_orderdate > TIMESTAMP '1998-08-01') AS future_dates, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders",
)
def integrity_report(t):
    return t("orders").agg(F.count("*").alias("total"), (F.count("*") - F.countDistinct("o_orderkey")).alias("duplicate_ids"), F.count_if(F.col("o_orderdate").isNull()).alias("no_date"), F.count_if(F.col("o_orderdate") > F.lit("1998-08-01").cast("timestamp")).alias("future_dates"), F.countDistinct(F.date_format("o_orderdate", "yyyy-MM")).alias("months"))


@query(
    "field_profile",
    "SELECT 'lang' AS field, count(lang) AS present, count(*) - count(lang) AS missing, count(DISTINCT lang) AS uniques FROM documents UNION ALL SELECT 'source', count(source), count(*) - count(source), count(DISTINCT source) FROM documents UNION ALL SELECT 'n_chars', count(n_chars), count(*) - count(n_chars), count(DISTINCT n_chars) FROM documents",
)
def field_profile(t):
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in ("lang", "source", "n_chars")])
    long = t("documents").select(F.explode(fields).alias("f")).select("f.*")
    return long.groupBy("field").agg(F.count("v").alias("present"), F.count_if(F.col("v").isNull()).alias("missing"), F.countDistinct("v").alias("uniques"))


@query(
    "validation_errors",
    "SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 50 THEN 'text too short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang not allowed' END, CASE WHEN source = 'src0' THEN 'blocked source' END], lambda x: x IS NOT NULL)) AS error FROM documents) GROUP BY 1",
)
def validation_errors(t):
    errors = F.array_compact(F.array(F.when(F.col("n_chars") < 50, "text too short"), F.when(~F.col("lang").isin("en", "de"), "lang not allowed"), F.when(F.col("source") == "src0", "blocked source")))
    return t("documents").select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("length_distribution", "SELECT CAST(len(string_split(p_name, ' ')) AS INTEGER) AS size, count(*) AS n FROM part GROUP BY 1")
def length_distribution(t):
    return t("part").groupBy(F.size(F.split("p_name", " ")).alias("size")).agg(F.count("*").alias("n"))


@query(
    "topic_stats",
    "SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS mean_p, round(min(embedding[1]::DOUBLE), 6) AS min_p, round(max(embedding[1]::DOUBLE), 6) AS max_p, round(100.0 * count(*) FILTER (embedding[1] > 0) / count(*), 4) AS pct_positive FROM embeddings GROUP BY label",
)
def topic_stats(t):
    p = F.get("embedding", F.lit(0)).cast("double")
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.min(p), 6).alias("min_p"), F.round(F.max(p), 6).alias("max_p"), F.round(100.0 * F.count_if(p > 0) / F.count("*"), 4).alias("pct_positive"))


@query("kinds_zero_filled", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'xx') AS xx FROM documents GROUP BY source")
def kinds_zero_filled(t):
    return t("documents").groupBy("source").pivot("lang", ["en", "de", "xx"]).count().na.fill(0)


@query("stats_sum_mean", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stats_sum_mean(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("corpus_coverage", "SELECT count(*) AS points, count(DISTINCT source) AS papers, count(*) FILTER (lang = 'en' AND n_chars > 1000) AS eligible FROM documents")
def corpus_coverage(t):
    return t("documents").agg(F.count("*").alias("points"), F.countDistinct("source").alias("papers"), F.count_if((F.col("lang") == "en") & (F.col("n_chars") > 1000)).alias("eligible"))


@query("above_quartile", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > (SELECT quantile_cont(n, 0.75) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))")
def above_quartile(t):
    d = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    q = d.agg(F.percentile("n", 0.75).alias("q"))
    return d.join(F.broadcast(q), F.col("n") > F.col("q")).select("o_custkey", "n")


@query("top_else_other", "SELECT CASE WHEN source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 5) THEN source ELSE 'Other' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def top_else_other(t):
    return ranking.top_else_other(t("documents").select("source"), "source", 5).groupBy("bucket").agg(F.count("*").alias("n"))


@query("min_max_normalise", "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS norm FROM supplier")
def min_max_normalise(t):
    s = t("supplier")
    b = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    return s.join(F.broadcast(b)).select("s_suppkey", F.round((F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("norm"))


@query("nearest_rank_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank_p95(t):
    return quantiles.nearest_rank(t("events"), ["event_type"], "value", 0.95, "p95")
