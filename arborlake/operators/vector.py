"""Dense vectors: exact k-NN, assignment to centroids, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine

#: Query or centroid vectors up to which a block is broadcast; beyond, blocks are scored one after another.
BLOCK_VECTORS = 4096
#: Rows that are scored against a block at a time.
CHUNK_ROWS = 256


def _few(vectors: DataFrame) -> DataFrame:
    """vectors, broadcast once it is known that there are no more than a block."""
    if vectors.limit(BLOCK_VECTORS + 1).count() > BLOCK_VECTORS:
        raise ValueError(f"more than {BLOCK_VECTORS} vectors on the broadcast side; use knn_blocks")
    return F.broadcast(vectors)


def knn(queries: DataFrame, vectors: DataFrame, query_key: str, key: str, vector: str, k: int) -> DataFrame:
    """Top k by cosine for one or few queries (rounded before ranking, so ties go to the smaller key).

    Scores are made where the vectors are; per query only the k best survive the
    first, map-side stage of the rank limit.
    """
    q = _few(queries.select(query_key, F.col(vector).alias("q_vec")))
    scored = vectors.join(q).select(query_key, key, F.round(cosine(F.col("q_vec"), F.col(vector)), 6).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of(batches: Iterator[tuple[np.ndarray, pd.Series]], names: np.ndarray, m: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, key, score) of the k best rows of (keys, vectors) batches for each unit row of m; CHUNK_ROWS x queries scores are held at a time."""
    near, keys, scores = np.zeros(0, np.int64), None, np.zeros(0)
    least = np.full(len(names), -np.inf)
    for all_keys, vectors in batches:
        for a in range(0, len(all_keys) if len(names) else 0, CHUNK_ROWS):
            v = np.stack(vectors.iloc[a : a + CHUNK_ROWS].to_numpy()).astype(np.float64)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            s = np.round(m @ np.divide(v, length, where=length > 0, out=np.zeros_like(v)).T, 6)
            floor = np.maximum(least, np.partition(s, -k, axis=1)[:, -k]) if len(v) > k else least
            i, j = np.nonzero(~(s < floor[:, None]))
            own = all_keys[a : a + CHUNK_ROWS][j]
            near, keys, scores = np.concatenate([near, i]), own if keys is None else np.concatenate([keys, own]), np.concatenate([scores, s[i, j]])
            order = np.lexsort((keys, -scores, near))
            nth = np.arange(len(near)) - np.searchsorted(near[order], near[order])
            order, nth = order[nth < k], nth[nth < k]
            near, keys, scores = near[order], keys[order], scores[order]
            least[near[nth == k - 1]] = scores[nth == k - 1]
    if keys is not None:
        yield names[near], keys, scores


def knn_blocks(queries: DataFrame, vectors: DataFrame, query_key: str, key: str, vector: str, k: int) -> DataFrame:
    """Top k for many queries: blocks of them are multiplied with a few rows at a time, keeping k per task."""
    spark = vectors.sparkSession
    n = queries.count()
    parts = -(-n // BLOCK_VECTORS)
    out = None
    for part in range(max(1, parts)):
        block = queries.where(F.pmod(F.xxhash64(query_key), F.lit(max(1, parts))) == part).select(query_key, vector).toPandas()
        q = np.stack(block[vector].to_numpy()).astype(np.float64) if len(block) else np.zeros((0, 1))
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((block[query_key].to_numpy(), np.divide(q, norm, where=norm > 0, out=np.zeros_like(q))))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for names, keys, scores in best_of(((p[key].to_numpy(), p[vector]) for p in batches if len(p)), *shared.value, k):
                yield pd.DataFrame({query_key: names, key: keys, "score": scores})

        types = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
        best = vectors.select(key, vector).mapInPandas(score, f"{query_key} {types[0]}, {key} {types[1]}, score double")
        out = best if out is None else out.unionByName(best)
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    sums = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dims)]
    return df.groupBy(label).agg(*sums).select(label, F.array(*[F.col(f"d{i}") for i in range(dims)]).alias("centroid"))


def assign(df: DataFrame, cents: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, similarity) of the nearest centroid; cents has one row per class (few by nature)."""
    scored = df.join(_few(cents.select(F.col(label).alias("to_"), "centroid"))).select(key, "to_", F.round(cosine(F.col(vector), F.col("centroid")), 6).alias("s_"))
    return scored.groupBy(key).agg(F.max_by("to_", F.struct("s_", -F.col("to_"))).alias("assigned"), F.max("s_").alias("similarity"))


def topic_matrix(df: DataFrame, cents: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, share): similarities floored at 0 and normalised to sum 1 per row."""
    s = F.greatest(F.lit(0.0), cosine(F.col(vector), F.col("centroid")))
    scored = df.select(key, vector).join(_few(cents.select(label, "centroid"))).select(key, label, s.alias("s_"))
    total = F.sum("s_").over(Window.partitionBy(key))
    return scored.select(key, label, F.round(F.try_divide(F.col("s_"), total), 6).alias("share"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(key, F.col("prediction").alias("cluster"))


def project_2d(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Two principal components: the linear stand-in for a neighbour-embedding plot."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(data).transform(data).withColumn("p", vector_to_array("p"))
    return out.select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def dimension_report(df: DataFrame, vector: str) -> DataFrame:
    size = F.size(vector)
    return df.agg(F.count("*").alias("vectors"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), F.count_if(size == 0).alias("empty")).withColumn("consistent", (F.col("min_dim") == F.col("max_dim")) & (F.col("empty") == 0))
