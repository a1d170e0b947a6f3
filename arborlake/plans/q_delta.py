"""Versioned rows merged on read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.delta import MergeTable
from ..session import shared_folder
from .registry import query

_SCHEMA = "o_orderkey long, version int, price double, mode string"
#: Version 1 of each order; then from its lines either what version 1 lacks, or version 2.
_LINES = "SELECT l_orderkey AS o_orderkey, 1 + (count(*) % 2)::INTEGER AS version, max(l_returnflag) AS mode FROM lineitem GROUP BY 1"


def _table(t) -> MergeTable:
    """Three appends, of which the second is older than the first, with the first two folded."""
    orders = t("orders").select("o_orderkey", F.lit(1).alias("version"), F.col("o_totalprice").cast("double").alias("price"), F.lit(None).cast("string").alias("mode"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_returnflag").alias("mode"))
    newer = lines.select("o_orderkey", (1 + F.col("n") % 2).cast("int").alias("version"), F.lit(None).cast("double").alias("price"), "mode")
    spark = orders.sparkSession
    path = f"{shared_folder(spark)}/merge-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    table = MergeTable(spark, path, _SCHEMA, ["o_orderkey"], "version", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    table.append(newer, 0)
    table.append(orders, 1)
    table.compact()
    table.append(orders, 1)
    table.append(orders.withColumn("version", F.lit(0)).withColumn("mode", F.lit("old")), 2)
    return table


@query(
    "merge_on_read",
    f"""WITH li AS ({_LINES}) SELECT o.o_orderkey, coalesce(li.version, 1) AS version, CASE WHEN li.version = 2 THEN NULL ELSE o_totalprice::DOUBLE END AS price, li.mode
FROM orders o LEFT JOIN li USING (o_orderkey)""",
)
def merge_on_read(t):
    return _table(t).current()


@query(
    "merge_archive",
    f"""WITH li AS ({_LINES}) SELECT o_orderkey, 0 AS version, o_totalprice::DOUBLE AS price, 'old' AS mode FROM orders
UNION ALL SELECT o.o_orderkey, 1, o_totalprice::DOUBLE, NULL FROM orders o JOIN li USING (o_orderkey) WHERE li.version = 2""",
)
def merge_archive(t):
    return _table(t).archive()
