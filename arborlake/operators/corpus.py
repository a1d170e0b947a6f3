"""Corpus policies: which records to retain, guards before a replacement, and the replacement."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import array_literal


@dataclass(frozen=True)
class RetentionPolicy:
    """Which categories and dates to keep, and what share of a corpus may remain."""

    categories: list[str] = field(default_factory=list)
    match: str = "any"
    start: str | None = None
    end: str | None = None
    minimum_fraction: float = 0.01
    maximum_fraction: float = 0.30

    def __post_init__(self) -> None:
        if self.match not in ("any", "all"):
            raise ValueError("match must be 'any' or 'all'")
        if not self.categories:
            raise ValueError("at least one category is required")
        if self.start and self.end and self.start > self.end:
            raise ValueError("start is after end")
        if not 0 <= self.minimum_fraction <= self.maximum_fraction <= 1:
            raise ValueError("fractions must be ordered within 0 and 1")

    def digest(self) -> Column:
        return F.sha2(F.lit(json.dumps(self.__dict__, sort_keys=True)), 256)

    def predicate(self, categories: Column, date: Column) -> Column:
        """Exact tokens, any or all; dates compare as strings, a missing date is not kept under a bound."""
        wanted = array_literal(self.categories)
        hit = F.arrays_overlap(categories, wanted) if self.match == "any" else F.size(F.array_except(wanted, categories)) == 0
        if self.start:
            hit = hit & (date >= self.start)
        if self.end:
            hit = hit & (date <= self.end)
        return F.coalesce(hit, F.lit(False))


def retain(df: DataFrame, policy: RetentionPolicy, categories: Column, date: Column) -> DataFrame:
    return df.where(policy.predicate(categories, date))


def violations(df: DataFrame, policy: RetentionPolicy, categories: Column, date: Column) -> DataFrame:
    return df.agg(F.count_if(~policy.predicate(categories, date)).alias("violations"))


def missing(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def guard(df: DataFrame, keep: Column, minimum: float, maximum: float) -> DataFrame:
    """One row: total, retained, fraction, errors. One pass."""
    counts = df.agg(F.count("*").alias("total"), F.count_if(keep).alias("retained"))
    counts = counts.withColumn("fraction", F.round(F.try_divide("retained", "total"), 6))
    fraction = F.try_divide("retained", "total")
    errors = F.concat_ws(
        ";",
        F.when(F.col("retained") <= 0, F.lit("nothing retained")),
        F.when(fraction < minimum, F.lit("fraction below minimum")),
        F.when(fraction > maximum, F.lit("fraction above maximum")),
    )
    return counts.withColumn("errors", errors)


def snapshot_identity(df: DataFrame, key: str, width: int = 1_000_000) -> DataFrame:
    """(snapshot, n): a digest of the distinct integer keys, made of the digests of their ranges of `width` keys.

    No task holds more than one range; the ranges' digests, a width-th of the keys at most, are hashed in order.
    """
    ids = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).distinct()
    ranges = ids.groupBy(F.floor(F.col("k") / width).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])
    return ranges.agg(F.sha2(F.array_join(in_order, "\n"), 256).alias("snapshot"), F.sum("n").alias("n"))


class VersionedTable:
    """A table as one folder per version and a pointer file, all through the cluster's file system.

    A replacement is written beside the current version, validated there, and
    becomes current by one rename; a failure leaves the current one untouched.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def current(self) -> str | None:
        """The version that the pointer with the largest number names."""
        n = self._newest()
        if not n:
            return None
        stream = self._fs.open(self._path(f"{self.path}/_pointers/{n:09d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _newest(self) -> int:
        root = self._path(f"{self.path}/_pointers")
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(root)], default=0) if self._fs.exists(root) else 0

    def read(self) -> DataFrame:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"no version of {self.path} is active")
        return self.spark.read.parquet(f"{self.path}/v={name}")

    def write(self, df: DataFrame, version: str, validate=None) -> str:
        """Write, then validate (a callable that returns errors), then activate."""
        target = f"{self.path}/v={version}"
        df.write.mode("overwrite").parquet(target)
        errors = validate(self.spark.read.parquet(target)) if validate else []
        if errors:
            self._fs.delete(self._path(target), True)
            raise ValueError("; ".join(errors))
        self.activate(version)
        return target

    def activate(self, version: str) -> None:
        if not self._fs.exists(self._path(f"{self.path}/v={version}")):
            raise FileNotFoundError(version)
        # A pointer's name is its number alone: of two writers that saw the same newest one, the second finds it taken.
        self._fs.mkdirs(self._path(f"{self.path}/_pointers"))
        n = 1 + self._newest()
        target = self._path(f"{self.path}/_pointers/{n:09d}")
        try:
            stream = self._fs.create(target, False)
        except Exception as error:
            raise RuntimeError("another writer activated a version") from error
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()


def replace_corpus(table: VersionedTable, df: DataFrame, policy: RetentionPolicy, categories: str, date: str, key: str, version: str) -> dict:
    """Plan, guard, write, validate, swap. Returns the plan's report."""
    keep = policy.predicate(F.col(categories), F.col(date))
    report = guard(df, keep, policy.minimum_fraction, policy.maximum_fraction).first().asDict()
    if report["errors"]:
        raise ValueError(report["errors"])

    def validate(out: DataFrame) -> list[str]:
        row = out.agg(
            F.count("*").alias("n"),
            F.count_if(~policy.predicate(F.col(categories), F.col(date))).alias("off"),
            F.count_if(missing(F.col(key))).alias("no_key"),
            (F.count(key) - F.countDistinct(key)).alias("twice"),
        ).first()
        found = {"count differs": row.n != report["retained"], "policy violated": row.off > 0, "missing key": row.no_key > 0, "duplicate key": row.twice > 0}
        return [k for k, v in found.items() if v]

    table.write(df.where(keep).withColumn("retention_policy_hash", policy.digest()), version, validate)
    return report
