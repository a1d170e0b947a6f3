"""Time series over counters and gauges, and their streaming forms."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_boxed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: float, clock: Callable[[], float] = time.monotonic):
    """Run a stream until it has nothing more or the time is up; it ends after a whole batch, and goes on from there the next time. At least one batch is run."""
    begun, late = clock(), threading.Event()

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if clock() - begun >= seconds:
            late.set()

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(1):
        if late.is_set():
            # stop() waits for the running batch; one that it interrupts is run again from its offsets.
            query.stop()
            break
    return query


def increases(df: DataFrame, series: list[str], ts: str, value: str, segment_seconds: int = 3600) -> DataFrame:
    """df with `increase`: growth since the series' last sample; after a reset, the value itself.

    A series is cut into time segments, which are what a task holds; a segment's
    first sample grows from the last one of the series' segment before, told by a
    table of one row a segment. Samples without a time come first.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = df.withColumn("seg_", F.coalesce(F.floor(micros / (segment_seconds * 1_000_000)), F.lit(-(1 << 62))))
    ends = cut.groupBy(*series, "seg_").agg(F.max(F.struct(ts, value)).getField(value).alias("end_"))
    before = ends.withColumn("before_", F.lag("end_").over(Window.partitionBy(*series).orderBy("seg_"))).drop("end_")
    of = before.withColumnsRenamed({c: f"{c}_of" for c in (*series, "seg_")})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in series]
    met = cut.join(of, [F.col("seg_") == F.col("seg__of"), *same]).drop(*[f"{c}_of" for c in (*series, "seg_")])
    w = Window.partitionBy(*series, "seg_").orderBy(ts, value)
    last = F.when(F.row_number().over(w) == 1, F.col("before_")).otherwise(F.lag(value).over(w))
    grown = met.withColumn("last_", last).drop("seg_", "before_")
    return grown.withColumn("increase", F.when(F.col("last_").isNull(), 0.0).when(F.col(value) >= F.col("last_"), F.col(value) - F.col("last_")).otherwise(F.col(value))).drop("last_")


def rate(df: DataFrame, series: list[str], ts: str, increase: str, window: str, slide: str | None = None) -> DataFrame:
    """Per-second growth per series and (sliding) window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return df.groupBy(*series, w.alias("w")).agg(F.sum(increase).alias("s")).select(*series, F.col("w.start").alias("window_start"), F.round(F.col("s") / seconds, 6).alias("rate"))


def irate(df: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """Per-second growth over each series' last two samples."""
    w = Window.partitionBy(*series).orderBy(F.desc(ts), F.desc(value))
    two = df.withColumn("n_", F.row_number().over(w)).where("n_ <= 2")
    both = two.groupBy(*series).agg(*[F.max(F.when(F.col("n_") == i, F.col(c))).alias(f"{n}{i}") for i in (1, 2) for n, c in (("t", ts), ("v", value))])
    growth = F.when(F.col("v1") >= F.col("v2"), F.col("v1") - F.col("v2")).otherwise(F.col("v1"))
    seconds = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t2").cast("timestamp"))) / 1e6
    return both.where("t2 is not null").select(*series, F.round(F.try_divide(growth, seconds), 4).alias("irate"))


def top_series(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def histogram_quantile(df: DataFrame, by: list[str], value: Column, bounds: list[float], q: float) -> DataFrame:
    """Quantile by linear interpolation inside cumulative buckets; values above the last bound count as it."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.count_if(value <= b) for b in bounds]).alias("cum"))
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    target = F.col("n") * q
    idx = F.size(F.filter("cum", lambda c: c < target))
    low = F.when(idx == 0, F.lit(0.0)).otherwise(F.get(edges, idx - 1))
    below = F.when(idx == 0, F.lit(0)).otherwise(F.get("cum", idx - 1))
    inside = F.get("cum", idx) - below
    value_at = low + (F.get(edges, idx) - low) * F.try_divide(target - below, inside)
    return counts.select(*by, F.round(F.when(idx >= len(bounds), F.lit(float(bounds[-1]))).otherwise(value_at), 6).alias("quantile"))


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Session windows (an extension): activity without a gap."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def replay_dedupe(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """A stream with repeated deliveries of an event dropped, state bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, ts: str, window: str, delay: str, *by: str) -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))


def resumable(spark, source: str, schema, sink: str, checkpoint: str, transform, max_files: int = 1000):
    """Process all files that have arrived since the last run, in bounded batches with durable offsets; returns the ended query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merge_versions(spark, source: str, schema, table, archive, key: list[str], version: str, ties: list[str], checkpoint: str):
    """Late and out-of-order versions: each micro-batch is upserted into a versioned table, superseded rows go to the archive table.

    Equal versions fill gaps of the stored row (see operators.versions). The
    archive is written first, so a batch that is run again after a failure
    finds its rows there and adds none twice.
    """
    from ..operators.versions import upsert

    def merge(batch: DataFrame, batch_id: int) -> None:
        none = spark.createDataFrame([], batch.schema)
        current = none if table.current() is None else table.read()
        old = none if archive.current() is None else archive.read()
        new_current, new_archive = upsert(current, old, batch, key, version, ties)
        archive.write(new_archive, f"batch{batch_id:09d}")
        table.write(new_current, f"batch{batch_id:09d}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
