"""Time-series queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import series
from .registry import query

_INC = "inc AS (SELECT *, CASE WHEN l IS NULL THEN 0 WHEN value >= l THEN value - l ELSE value END AS increase FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, value) AS l FROM events))"


def grown(t):
    return series.increases(t("events").select("ts", "event_type", "user_id", "value"), ["event_type"], "ts", "value")


@query("rate_5m", f"WITH {_INC} SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, round(sum(increase) / 300, 6) AS rate FROM inc GROUP BY 1, 2")
def rate_5m(t):
    return series.rate(grown(t), ["event_type"], "ts", "increase", "5 minutes")


@query("rate_sliding", f"WITH {_INC}, w AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM inc) SELECT event_type, window_start, round(sum(increase) / 3600, 6) AS rate FROM w GROUP BY 1, 2")
def rate_sliding(t):
    return series.rate(grown(t), ["event_type"], "ts", "increase", "60 minutes", "30 minutes")


@query(
    "irate",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS n FROM events) SELECT a.user_id, round(CASE WHEN a.value >= b.value THEN a.value - b.value ELSE a.value END / ((epoch_us(a.ts) - epoch_us(b.ts)) / 1e6), 4) AS irate FROM r a JOIN r b ON a.user_id = b.user_id AND a.n = 1 AND b.n = 2",
)
def irate(t):
    return series.irate(t("events").select("user_id", "ts", "value"), ["user_id"], "ts", "value")


@query("sum_by_label", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def sum_by_label(t):
    return t("events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("ratio_of_rates", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, round(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS ratio FROM events GROUP BY 1")
def ratio_of_rates(t):
    return t("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.try_divide(F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "view")), 6).alias("ratio"))


@query("topk_rate", "SELECT day, user_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS rank FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rank <= 5")
def topk_rate(t):
    c = t("events").groupBy(F.date_trunc("day", "ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    return series.top_series(c, ["day"], "n", "user_id", 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    "hist_quantile",
    "WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0]) AS le, unnest([0.0, 1.0, 5.0, 10.0, 50.0, 100.0]) AS lo), c AS (SELECT event_type, le, lo, count(*) FILTER (value <= le) AS cum, count(*) FILTER (value <= lo) AS below, count(*) AS n FROM events, b GROUP BY 1, 2, 3) SELECT event_type, round(lo + (le - lo) * (0.95 * n - CASE WHEN lo = 0 THEN 0 ELSE below END) / (cum - CASE WHEN lo = 0 THEN 0 ELSE below END), 6) AS quantile FROM c WHERE cum >= 0.95 * n AND (below < 0.95 * n OR lo = 0) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1",
)
def hist_quantile(t):
    return series.histogram_quantile(t("events"), ["event_type"], F.col("value"), [1, 5, 10, 50, 100, 500], 0.95)


@query("gauge_arithmetic", "SELECT s_nationkey, round(100 - 100 * min(s_acctbal) / max(s_acctbal), 4) AS used FROM supplier GROUP BY 1")
def gauge_arithmetic(t):
    return t("supplier").groupBy("s_nationkey").agg(F.round(100 - 100 * F.min("s_acctbal") / F.max("s_acctbal"), 4).alias("used"))


@query("label_regex", "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, '^(view|click)$') GROUP BY 1")
def label_regex(t):
    return t("events").where(F.col("event_type").rlike("^(view|click)$")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("threshold_alert", "SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 15")
def threshold_alert(t):
    return t("events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors")).where("errors > 15")


@query("latest_up", "SELECT count(*) AS targets, count(*) FILTER (event_type <> 'error') AS up FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1)")
def latest_up(t):
    last = t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("e"))
    return last.agg(F.count("*").alias("targets"), F.count_if(F.col("e") != "error").alias("up"))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def tumbling_windows(t):
    return t("events").groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


@query(
    "session_windows",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid",
)
def session_windows(t):
    return series.sessions(t("events"), "user_id", "ts", "2 hours")


@query("replay_dedupe", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def replay_dedupe(t):
    """Batch twin of the streaming operator: the same events delivered twice count once."""
    e = t("events").select("event_id", "event_type")
    return e.unionByName(e).dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))
