"""Indexes that queries share: built once a session from their table, in the folder the cluster shares."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.postings import PostingsIndex
from ..operators.vector_index import VectorIndex
from ..session import shared_folder

DIMS = 64


def _once(table: DataFrame, name: str, build: Callable[[str], object], read: Callable[[str], object]):
    spark = table.sparkSession
    files = hashlib.sha256("\n".join(sorted(table.inputFiles())).encode()).hexdigest()[:16]
    path = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}/{name}-{files}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return read(path)
    return build(path)


def postings(t) -> PostingsIndex:
    docs = t("documents")
    return _once(docs, "postings", lambda path: PostingsIndex.build(docs, "doc_id", "text", path), lambda path: PostingsIndex(docs.sparkSession, path))


def vectors(t) -> VectorIndex:
    v = t("embeddings")
    whole = v.where((F.size("embedding") == DIMS) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    return _once(v, "vectors", lambda path: VectorIndex.build(whole, "vec_id", "embedding", path, DIMS, payload=("label",)), lambda path: VectorIndex.open(v.sparkSession, path, DIMS))


def query_vector(t, vec_id: int) -> list[float]:
    return t("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]
