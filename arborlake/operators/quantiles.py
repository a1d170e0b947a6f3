"""Exact quantiles by selection: histograms of a range that narrows until one value is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BINS = 1024


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float, name: str = "quantile", bins: int = BINS) -> DataFrame:
    """(by..., name): per group the value at rank ceil(q * n) of its n values, at least the first.

    Each pass counts a group's values of the range that is left in `bins` bins,
    with the least and largest of each: counts merge before the shuffle, so a
    task sees bins and never a group's values. The bin that holds the rank is the
    next range; its ends lie in different bins, so every pass narrows it. Nulls
    and NaN are no values; a group without any is not in the result.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    v = F.col(value).cast("double")
    rows = cut(df.select(*by, v.alias("v_")).where(F.col("v_").isNotNull() & ~F.isnan("v_")))
    keys = [f"{c}_of" for c in by]
    # Products of decimals and counts round up where they should be whole.
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.lit(q) * F.count("*"), 9))).cast("long")
    state = cut(rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.min("v_").alias("low"), F.max("v_").alias("high"), rank.alias("rank")))
    done = state.where("low = high")
    while True:
        left = state.where("low < high")
        if left.isEmpty():
            break
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
        met = rows.join(left, [*same, F.col("v_").between(F.col("low"), F.col("high"))])
        # The difference of two doubles may not be one; that of their halves is, but vanishes for the smallest.
        width = F.col("high") - F.col("low")
        halves = F.try_divide(F.col("v_") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        place = F.floor(F.when(width == float("inf"), halves).otherwise(F.try_divide(F.col("v_") - F.col("low"), width)) * bins)
        binned = met.groupBy(*keys, "rank", F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min("v_").alias("low"), F.max("v_").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin"))
        here = binned.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        state = cut(here.select(*keys, "low", "high", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")))
        done = done.unionByName(state.where("low = high"))
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.col("low").alias(name))
