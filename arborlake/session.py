"""Session defaults, and the package on executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def build_session(app: str = "arborlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; sizes are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_own_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares (spark.checkpoint.dir); a local one only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="arborlake-")
    return _own_roots[app]


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once to the folder the cluster shares, and read from there. It goes when the driver ends."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}"
    if where not in _own_roots.values():
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _own_roots[f"cut {where}"] = where
    at = f"{where}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, unless their Python path has it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp()) / "arborlake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (ROOT / "arborlake").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
