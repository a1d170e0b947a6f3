"""Tables in the folder that the whole cluster shares.

Operators that read an intermediate result more than once write it here as
Parquet: the lineage is cut, nothing is computed twice, and a lost executor
costs no more than the tasks it was running.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names; a local one only where it names none and all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="arborlake-")
    return _own_roots[app]


#: Rows of an Arrow batch where the session sets no other number: texts are long, and a batch stands in the executor's and in its worker's memory.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Scratch tables of one operator call."""

    def __init__(self, spark: SparkSession, tag: str):
        bound_batches(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _made.append(self.path)

    def table(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write df, read it back with the same schema."""
        self._n += 1
        path = f"{self.path}/t{self._n}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner drop the shuffle files of finished steps."""
        gc.collect()
        self.spark._jvm.System.gc()


def made() -> int:
    """How many scratch folders there have been."""
    return len(_made)


def sweep(spark: SparkSession, since: int, keep: Scratch) -> None:
    """Delete the folders made since, but for keep's: their results have been written elsewhere."""
    conf = spark._jsc.hadoopConfiguration()
    for at in [p for p in _made[since:] if p != keep.path]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
    _made[since:] = [keep.path] if keep.path in _made[since:] else []
