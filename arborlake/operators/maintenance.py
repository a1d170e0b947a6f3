"""Table maintenance: upserts by key, file records, copies, clears, reports, and resumable, time-boxed indexing."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the cluster's file system; null if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it, then renamed over it in one step, so that a crash leaves the old or the new one."""
    p, fs = _path(spark, path)
    beside, _ = _path(spark, path + ".new")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    over = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(over, 1)
    how[0] = over.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, p, how)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as indented JSON with sorted keys."""
    write_text(spark, path, json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def upsert_by_key(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """stored with incoming rows put in the place of those of their key; of several incoming rows of a key, the greatest by order (or by all columns) counts."""
    rest = [c for c in stored.columns if c not in key]
    best = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("v_")).select(*key, "v_.*")
    return stored.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(best.select(*stored.columns))


def record_files(live: DataFrame, archive: DataFrame, files: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(live, archive) with the fields of downloaded files: a file belongs to the live row of its key, or else to the archived one."""
    one = files.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*fields)).alias("f_"))

    def recorded(df: DataFrame, of: DataFrame) -> DataFrame:
        j = df.join(of, key, "left")
        return j.select(*[F.coalesce(F.col(f"f_.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])

    return recorded(live, one), recorded(archive, one.join(live.select(key), key, "left_anti"))


def copy_snapshot(df: DataFrame, root: str, name: str, day: str) -> str:
    """Write df under a dated name that must not exist yet; returns the path."""
    path = f"{root.rstrip('/')}/{name}_{day}"
    df.write.mode("errorifexists").parquet(path)
    return path


def clear(spark: SparkSession, tables: dict[str, str], confirm: bool = False) -> dict[str, int]:
    """Rows of each table that a clear deletes; they go only with confirm."""
    counts = {name: spark.read.parquet(path).count() for name, path in tables.items()}
    if confirm:
        for path in tables.values():
            p, fs = _path(spark, path)
            fs.delete(p, True)
    return counts


class IndexMismatch(RuntimeError):
    pass


@dataclass
class IndexRun:
    """Indexing in keyset batches that stops at batch boundaries and goes on where the last run stopped.

    `index` gets one batch as a DataFrame and returns how many points it wrote;
    `count` tells how many the index has. The checkpoint is one small file.
    """

    spark: SparkSession
    source: DataFrame
    key: str
    index: Callable[[DataFrame], int]
    count: Callable[[], int]
    checkpoint: str
    batch: int = 1000
    clock: Callable[[], float] = time.monotonic

    def state(self) -> dict:
        return json.loads(read_text(self.spark, self.checkpoint) or '{"processed": 0, "last": null, "status": "new"}')

    def run(self, most: int | None = None, this_run: int | None = None, minutes: float | None = None) -> dict:
        """Index until the source, `most` in all, `this_run` now, or the minutes are used up (of the last two, one at most); returns the state."""
        if this_run is not None and minutes is not None:
            raise ValueError("a run is limited by rows or by minutes, not by both")
        state = self.state()
        begun, done, first = self.clock(), 0, True
        total = self.source.count()
        while True:
            room = min([self.batch, *([most - state["processed"]] if most is not None else []), *([this_run - done] if this_run is not None else [])])
            if room <= 0 or (minutes is not None and not first and self.clock() - begun >= 60 * minutes):
                break
            rest = self.source if state["last"] is None else self.source.where(F.col(self.key) > F.lit(state["last"]))
            batch = rest.orderBy(self.key).limit(room)
            # Only the batch's size and last key come to the driver.
            seen = batch.agg(F.count("*").alias("n"), F.max(self.key).alias("last")).first()
            if not seen["n"]:
                break
            written = self.index(batch)
            if written != seen["n"]:
                raise IndexMismatch(f"{written} points for {seen['n']} rows")
            state |= {"processed": state["processed"] + written, "last": seen["last"], "status": "running"}
            done, first = done + written, False
            write_text(self.spark, self.checkpoint, json.dumps(state))
        have = self.count()
        if have != state["processed"]:
            raise IndexMismatch(f"the index has {have} points, {state['processed']} were processed")
        state |= {"status": "complete" if have == total else "partial"}
        write_text(self.spark, self.checkpoint, json.dumps(state))
        return state
