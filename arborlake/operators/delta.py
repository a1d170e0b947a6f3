"""A table of versioned rows that is merged when it is read: a bucketed base, one small delta a batch, and compaction.

An append writes the batch's rows and nothing else. Reading folds base and
deltas: of the rows of one key and version, each column has the value that came
last and is not null; a key's current row is that of its greatest version, and
its other versions are the archive. So the order in which versions arrive does
not matter, and what a version lacks can be filled later.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Added columns: the bucket (a folder of its own) and the number of the commit that wrote the row.
_BUCKET, _SEQ = "b_", "seq_"


class CommitConflict(RuntimeError):
    """Another writer committed first; what this one wrote is in no manifest and `vacuum` takes it away."""


@dataclass
class MergeTable:
    """Rows of `schema` under `path`, told apart by `key` and `version` (null: before all others).

    A commit is one numbered manifest that must not exist yet: it names the base
    folder of each bucket, the deltas with the buckets they touch, and the last
    batch. A batch whose number is not above that one is in the table already and
    is not written again. Of several rows of one key and version in a batch the
    greatest by `ties` counts, nulls last. No row is ever changed in place, so
    readers of an older manifest are not disturbed until `vacuum`.
    """

    spark: SparkSession
    path: str
    schema: str
    key: Sequence[str]
    version: str
    ties: Sequence[str] = ()
    buckets: int = 64

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self._hadoop = self.spark._jvm.org.apache.hadoop.fs
        self._fs = self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.columns = self.spark.createDataFrame([], self.schema).columns

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def state(self) -> dict:
        """The newest manifest."""
        numbers = [int(n) for n in self._names(f"{self.path}/_log") if n.isdigit()]
        if not numbers:
            return {"seq": 0, "batch": -1, "buckets": self.buckets, "base": {}, "deltas": {}}
        stream = self._fs.open(self._at(f"{self.path}/_log/{max(numbers):09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        # Written in full under a name of its own and then renamed, so that no reader sees half a manifest; a rename does not replace.
        target = self._at(f"{self.path}/_log/{state['seq']:09d}")
        beside = self._at(f"{self.path}/_log/{state['seq']:09d}.{self.spark._jvm.java.util.UUID.randomUUID()}")
        self._fs.mkdirs(self._at(f"{self.path}/_log"))
        stream = self._fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        options = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE
        try:
            self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, target, how)
        except Exception as error:
            self._fs.delete(beside, False)
            raise CommitConflict(f"commit {state['seq']} is taken") from error

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, state: dict, kind: str) -> tuple[str, list[int]]:
        """Write rows for the commit after `state`; returns the folder and the buckets in it."""
        folder = f"{kind}-{state['seq'] + 1:09d}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        numbered = rows.select(*self.columns, F.lit(state["seq"] + 1).cast("long").alias(_SEQ), self._bucket(state["buckets"]).alias(_BUCKET))
        numbered.write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        return folder, sorted(int(n.split("=")[1]) for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{_BUCKET}="))

    def append(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Add rows in any order of versions; false if this batch is in the table. What it costs depends on the rows alone."""
        state = self.state()
        if batch is not None and batch <= state["batch"]:
            return False
        rest = [c for c in self.columns if c not in self.key]
        order = F.struct(*[f(c) for c in self.ties for f in (lambda c: F.col(c).isNotNull(), F.col)], *rest)
        best = rows.groupBy(*self.key, F.coalesce(F.col(self.version), F.lit(-1)).alias("v_")).agg(F.max_by(F.struct(*rest), order).alias("r_")).select(*self.key, "r_.*")
        folder, touched = self._write(best, state, "delta")
        deltas = state["deltas"] | ({folder: touched} if touched else {})
        self._commit(state | {"seq": state["seq"] + 1, "batch": state["batch"] if batch is None else batch, "deltas": deltas})
        return True

    def _stored(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        parts = [(folder, b) for b, folder in state["base"].items()] + [(d, b) for d, touched in state["deltas"].items() for b in touched]
        paths = [f"{self.path}/{folder}/{_BUCKET}={b}" for folder, b in parts if buckets is None or int(b) in buckets]
        empty = self.spark.createDataFrame([], f"{self.schema}, {_SEQ} long")
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def _folded(self, stored: DataFrame) -> DataFrame:
        """One row a key and version (as v_). Rows meet once, by key, so that what follows by key needs no further exchange."""
        rest = [c for c in self.columns if c not in self.key]
        filled = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(_SEQ))).alias(c) for c in rest]
        met = stored.withColumn("v_", F.coalesce(F.col(self.version), F.lit(-1))).repartition(*self.key)
        return met.groupBy(*self.key, "v_").agg(*filled)

    def versions(self, keys: DataFrame | None = None) -> DataFrame:
        """One row a key and version. keys: only those of this small table; only their buckets are read."""
        state = self.state()
        if keys is None:
            return self._folded(self._stored(state)).select(*self.columns)
        of = keys.select(*self.key).distinct()
        # No more numbers than there are buckets come to the driver.
        touched = {r[0] for r in of.select(self._bucket(state["buckets"])).distinct().collect()}
        return self._folded(self._stored(state, touched).join(of, list(self.key), "left_semi")).select(*self.columns)

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """The greatest version of each key."""
        rest = [c for c in self.columns if c not in self.key]
        newest = self.versions(keys).groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(self.version), F.lit(-1))).alias("r_"))
        return newest.select(*self.key, "r_.*").select(*self.columns)

    def archive(self, keys: DataFrame | None = None) -> DataFrame:
        """All versions but the current ones."""
        every = self.versions(keys).withColumn("v_", F.coalesce(F.col(self.version), F.lit(-1)))
        top = every.groupBy(*[F.col(c).alias(f"{c}_of") for c in self.key]).agg(F.max("v_").alias("top_"))
        return every.join(top, [*[F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in self.key], F.col("v_") < F.col("top_")], "left_semi").select(*self.columns)

    def compact(self) -> int:
        """Fold the deltas into the base of the buckets they touch; returns how many buckets were written. Others keep their files."""
        state = self.state()
        touched = {b for of in state["deltas"].values() for b in of}
        if not touched:
            return 0
        folder, _ = self._write(self._folded(self._stored(state, touched)), state, "base")
        self._commit(state | {"seq": state["seq"] + 1, "base": state["base"] | {str(b): folder for b in touched}, "deltas": {}})
        return len(touched)

    def vacuum(self) -> int:
        """Delete folders that the newest manifest does not name; for when nobody reads or writes. Returns how many."""
        state = self.state()
        named = {*state["base"].values(), *state["deltas"], "_log"}
        old = [n for n in self._names(self.path) if n not in named]
        for n in old:
            self._fs.delete(self._at(f"{self.path}/{n}"), True)
        return len(old)


def merge_stream(spark: SparkSession, source: str, table: MergeTable, checkpoint: str, compact_after: int = 16, max_files: int = 1000):
    """Late and out-of-order versions from Parquet files as they arrive: each micro-batch is one append; after so many deltas they are folded."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, batch_id)
        if len(table.state()["deltas"]) >= compact_after:
            table.compact()

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
