"""Ranks and joins that no hot key can gather into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

BLOCK = 50_000


def gapless_rank(df: DataFrame, key: list[str], unique: list[str], rows: int, weight: Column | None = None, name: str = "rank_") -> DataFrame:
    """Add name: 0-based gapless rank within key (or, with weight, the sum of the weights before the row).

    Each key is dealt into blocks by a hash of the unique columns, of about BLOCK
    rows over all keys' worst case; ranks are counted inside a block and shifted
    by the counts of the key's earlier blocks, a table of keys x blocks rows. So
    the largest task holds one block, whatever share of the rows a key has.
    """
    blocks = max(1, -(-rows // BLOCK))
    w = F.lit(1) if weight is None else weight
    dealt = df.withColumn("b_", F.pmod(F.xxhash64(*unique, F.lit(7)), F.lit(blocks)).cast("int")).withColumn("w_", w.cast("long"))
    inner = Window.partitionBy(*key, "b_").orderBy(*unique).rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("in_", F.sum("w_").over(inner) - F.col("w_"))
    sums = dealt.groupBy(*key, "b_").agg(F.sum("w_").alias("n_"))
    outer = Window.partitionBy(*key).orderBy("b_").rowsBetween(Window.unboundedPreceding, 0)
    shifts = sums.withColumn("before_", F.sum("n_").over(outer) - F.col("n_")).drop("n_")
    return ranked.join(shifts, [*key, "b_"]).withColumn(name, F.col("in_") + F.col("before_")).drop("b_", "w_", "in_", "before_")


def split_join(many: DataFrame, one: DataFrame, key: list[str], size: str, rows: int, parts: int = 2000) -> DataFrame:
    """Left join many with one (unique by key), where one.size says how many rows of many carry its key.

    Keys with more than rows/parts rows are at most `parts` of them, so their
    side is broadcast and hot keys are never shuffled; all others are joined by
    a shuffle in which no key is large.
    """
    limit = max(1000, rows // parts)
    hot = F.broadcast(one.where(F.col(size) > limit).withColumn("hot_", F.lit(True)))
    cold = one.where(F.col(size) <= limit)
    tagged = many.join(hot.select(*key, "hot_"), key, "left")
    first = tagged.where(F.col("hot_")).drop("hot_").join(hot.drop("hot_"), key)
    second = tagged.where(F.col("hot_").isNull()).drop("hot_").join(cold, key, "left")
    return first.unionByName(second)


def keyed(scratch: Scratch, docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """docs with a unique long `key`: the id where every row has one of its own, and else a number given to each row in a copy."""
    ids = docs.select(F.col(id_col).cast("long").alias("i_")).agg(F.count("*").alias("n"), F.count_distinct("i_").alias("d")).first()
    if ids["n"] == ids["d"]:
        return docs.withColumn(key, F.col(id_col).cast("long"))
    return scratch.table(docs.withColumn(key, F.monotonically_increasing_id()))
