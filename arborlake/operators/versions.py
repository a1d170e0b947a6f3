"""Version-aware merges: current and archive tables as the result of joins, not of row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_latest(df: DataFrame, key: list[str], *order: Column) -> tuple[DataFrame, DataFrame]:
    """(latest row per key, all others); order: descending sort columns, the last one a tie breaker."""
    ranked = df.withColumn("rn_", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("rn_ = 1").drop("rn_"), ranked.where("rn_ > 1").drop("rn_")


def disposition(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Keys with what an upsert does to them: insert, update, merge, archive_incoming or keep."""
    a = current.select(*key, F.coalesce(F.col(version), F.lit(-1)).alias("current_version"), F.lit(1).alias("has_a"))
    b = incoming.select(*key, F.coalesce(F.col(version), F.lit(-1)).alias("incoming_version"), F.lit(1).alias("has_b"))
    j = a.join(b, key, "full_outer")
    what = (
        F.when(F.col("has_b").isNull(), "keep")
        .when(F.col("has_a").isNull(), "insert")
        .when(F.col("incoming_version") > F.col("current_version"), "update")
        .when(F.col("incoming_version") == F.col("current_version"), "merge")
        .otherwise("archive_incoming")
    )
    return j.select(*key, "current_version", "incoming_version", what.alias("disposition"))


def upsert(current: DataFrame, archive: DataFrame, incoming: DataFrame, key: list[str], version: str, ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new current, new archive). Best incoming per key first; equal versions fill gaps of the stored row."""
    best, rest = split_latest(incoming, key, F.coalesce(F.col(version), F.lit(-1)).desc(), *[F.col(t).desc_nulls_last() for t in ties])
    plan = disposition(current, best, key, version).select(*key, "disposition")
    others = [c for c in current.columns if c not in key]
    a = current.select(*key, *[F.col(c).alias(f"a_{c}") for c in others])
    b = best.select(*key, *[F.col(c).alias(f"b_{c}") for c in others])
    j = plan.join(a, key, "left").join(b, key, "left")

    def pick(c: str) -> Column:
        new, old = F.col(f"b_{c}"), F.col(f"a_{c}")
        d = F.col("disposition")
        return F.when(d.isin("insert", "update"), new).when(d == "merge", F.coalesce(new, old)).otherwise(old).alias(c)

    new_current = j.select(*key, *[pick(c) for c in others])
    replaced = j.where("disposition = 'update'").select(*key, *[F.col(f"a_{c}").alias(c) for c in others])
    older = j.where("disposition = 'archive_incoming'").select(*key, *[F.col(f"b_{c}").alias(c) for c in others])
    # Of the new rows of one key and version the first by the ties stays; what the archive has already is not added again.
    fresh, _ = split_latest(replaced.unionByName(older).unionByName(rest.select(*archive.columns)).select(*archive.columns), [*key, version], *[F.col(t).desc_nulls_last() for t in ties])
    known = archive.select(*[F.col(c).alias(f"k_{c}") for c in (*key, version)])
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in (*key, version)]
    new_archive = archive.unionByName(fresh.join(known, same, "left_anti"))
    return new_current, new_archive


def tracking_diff(stored: DataFrame, found: DataFrame, key: list[str], digest: str) -> DataFrame:
    """added, updated, unchanged or removed for each key of either side."""
    j = stored.select(*key, F.col(digest).alias("d0"), F.lit(1).alias("s")).join(found.select(*key, F.col(digest).alias("d1"), F.lit(1).alias("f")), key, "full_outer")
    status = F.when(F.col("s").isNull(), "added").when(F.col("f").isNull(), "removed").when(F.col("d0").eqNullSafe(F.col("d1")), "unchanged").otherwise("updated")
    return j.select(*key, status.alias("status"))


def reconcile(tracked: DataFrame, indexed: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with what to do: backfill into the index, or delete from it."""
    return tracked.select(*key).distinct().join(indexed, key, "left_anti").withColumn("action", F.lit("backfill")).unionByName(indexed.select(*key).distinct().join(tracked, key, "left_anti").withColumn("action", F.lit("delete")))


def append_new(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Incoming rows whose key is not stored, one a key: the greatest by order (or by all other columns). The idempotent append."""
    rest = [c for c in incoming.columns if c not in key]
    if not rest:
        return incoming.distinct().join(stored.select(*key), key, "left_anti")
    best = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("v_"))
    return best.select(*key, "v_.*").select(*incoming.columns).join(stored.select(*key), key, "left_anti")


def current_flag(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return df.withColumn("is_current", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)
