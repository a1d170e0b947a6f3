"""A stored inverted-file index of vectors, by cosine.

Unit vectors lie in a table partitioned by cell; beside each stands a code of
what is left of it after its cell's centroid, one signed byte a dimension, and
how far the code is off. A search scores the cells nearest to the query by their
codes: a score plus or minus the error encloses the true one, so the vectors
that may be among the best k are known and only they are scored in full. The
exact search goes on to every cell whose centroid and radius leave it a chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cells as cells_

#: Recall at 10 that the number of probes is chosen for, and stored vectors that it is measured with.
GOAL, JUDGES = 0.93, 200
#: Rows (a query in one of its cells) that a task holds when it sends queries to cells.
SENT_ROWS = 16_384


class IndexMismatch(ValueError):
    """Vectors that do not belong into an index."""


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, where=length > 0, out=np.zeros_like(x))


def refuse_others(vectors: DataFrame, vector: str, dims: int) -> None:
    """An error if a vector is null, of another length, or not finite."""
    v = F.col(vector)
    bad = F.coalesce(F.size(v) != dims, F.lit(True)) | v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    n = vectors.where(bad).count()
    if n:
        raise IndexMismatch(f"{n} vectors are not {dims} finite numbers")


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    key: str
    dims: int
    model: str
    centroids: np.ndarray
    radius: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str, path: str, dims: int, model: str = "", cells: int | None = None, payload: tuple[str, ...] = (), sample: int = cells_.SAMPLE, goal: float = GOAL) -> VectorIndex:
        """Write the index. Vectors of other than `dims` finite numbers are refused; those of length zero have no direction and are left out."""
        refuse_others(vectors, vector, dims)
        spark = vectors.sparkSession
        rows = vectors.select(F.col(key), *payload, F.col(vector).cast("array<double>").alias("vector")).where(F.exists("vector", lambda x: x != 0))
        normed = rows.withColumn("vector", F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y * y))))
        c = cells_.fit_centroids(normed, "vector", cells, sample)

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _unit(np.stack(pdf["vector"].to_numpy()))
                d = cells_.squared(x, c)
                cell = d.argmin(axis=1)
                rest = x - c[cell]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                codes = np.round(rest / scale[:, None]).astype(np.int8)
                off = np.linalg.norm(rest - codes * scale[:, None], axis=1)
                yield pdf.assign(vector=list(x), code=[r.tobytes() for r in codes], scale=scale, off=off, d=np.sqrt(d.min(axis=1)), cell=cell.astype(np.int32))

        schema = ", ".join([f"`{f}` {t}" for f, t in rows.dtypes] + ["code binary", "scale double", "off double", "d double", "cell int"])
        coded = rows.mapInPandas(code, schema)
        coded.repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/vectors")
        far = {r["cell"]: r["d"] for r in spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("d").alias("d")).collect()}
        told = [(i, v.tolist(), float(far.get(i, -1.0))) for i, v in enumerate(c)]
        spark.createDataFrame(told, "cell int, centroid array<double>, radius double").coalesce(1).write.parquet(f"{path}/cells")
        index = cls(spark, path, key, dims, model, c, np.array([far.get(i, -1.0) for i in range(len(c))]), len(c))
        probes = index._probes_for(goal)
        spark.createDataFrame([(key, dims, model, probes)], "key string, dims int, model string, probes int").coalesce(1).write.parquet(f"{path}/meta")
        return cls.open(spark, path, dims, model)

    def _probes_for(self, goal: float, k: int = 10) -> int:
        """The fewest nearest cells that hold `goal` of the k true neighbours of at most JUDGES stored vectors."""
        judges = self.vectors().select(F.col(self.key).alias("judge_"), "vector").orderBy(F.xxhash64(self.key)).limit(JUDGES)
        x = {r["judge_"]: np.array(r["vector"]) for r in judges.collect()}
        truth = self.search_many(judges, "judge_", "vector", k + 1, len(self.centroids)).where(F.col("judge_") != F.col(self.key))
        held = truth.select("judge_", self.key).join(self.vectors().select(self.key, "cell"), self.key).select("judge_", "cell").collect()
        if not held:
            return 1
        used = np.flatnonzero(self.radius >= 0)
        order = {j: used[np.argsort(cells_.squared(v[None], self.centroids[used])[0], kind="stable")].tolist() for j, v in x.items()}
        place = sorted(order[r["judge_"]].index(r["cell"]) for r in held)
        return 1 + place[min(len(place) - 1, int(np.ceil(goal * len(place))) - 1)]

    @classmethod
    def open(cls, spark: SparkSession, path: str, dims: int | None = None, model: str | None = None) -> VectorIndex:
        """The index at path; an error if it holds vectors of another length or model."""
        meta = spark.read.parquet(f"{path}/meta").first()
        for name, want in (("dims", dims), ("model", model)):
            if want is not None and meta[name] != want:
                raise IndexMismatch(f"the index has {name} {meta[name]!r}, not {want!r}; use a new path for another model")
        # At most MAX_CELLS rows.
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        return cls(spark, path, meta["key"], meta["dims"], meta["model"], np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows]), meta["probes"])

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def status(self) -> DataFrame:
        """(vectors, cells, dims, model), from the table's own counts."""
        return self.vectors().agg(F.count("*").alias("vectors"), F.count_distinct("cell").alias("cells")).select("*", F.lit(self.dims).alias("dims"), F.lit(self.model).alias("model"))

    def _query(self, q) -> np.ndarray:
        q = np.asarray(q, float)
        if q.shape != (self.dims,) or not np.isfinite(q).all():
            raise IndexMismatch(f"a query is {self.dims} finite numbers")
        return _unit(q[None])[0]

    def search(self, q, k: int, probes: int | None = None, where: Column | None = None, least: float | None = None, exact: bool = False) -> DataFrame:
        """(key, score, rank, payload...): the k most similar vectors, scores rounded to 6 digits, ties to the smaller key.

        where: a condition on key and payload, which reaches the scan. least: the
        score that a hit has at least. exact: no vector is missed; else those in
        the `probes` nearest cells are compared (as many as the index was measured to need). An all-zero query finds nothing.
        """
        unit = self._query(q)
        away = np.sqrt(cells_.squared(unit[None], self.centroids)[0])
        used = np.flatnonzero(self.radius >= 0)
        near = used[np.argsort(away[used], kind="stable")][: probes or self.probes]
        if not unit.any():
            near = near[:0]
        found = self._best(unit, near, k, where, least)
        if exact and unit.any():
            worst = found.agg(F.min("score").alias("s"), F.count("*").alias("n")).first()
            goal = worst["s"] if worst["n"] >= k else -1.0
            # Two unit vectors d apart have cosine 1 - d * d / 2.
            chance = 1 - np.maximum(away - self.radius - 1e-9, 0) ** 2 / 2
            more = [i for i in used.tolist() if i not in set(near.tolist()) and chance[i] >= max(goal, -1.0 if least is None else least) - 1e-5]
            if more:
                found = found.unionByName(self._best(unit, np.array(more), k, where, least))
        order = [F.desc("score"), F.col(self.key)]
        top = found.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    def _best(self, unit: np.ndarray, cells: np.ndarray, k: int, where: Column | None, least: float | None) -> DataFrame:
        c, key = self.centroids, self.key
        rows = self.vectors().where(F.col("cell").isin([int(i) for i in cells]))
        if where is not None:
            rows = rows.where(where)

        def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                cell = pdf["cell"].to_numpy()
                codes = np.frombuffer(b"".join(pdf["code"]), np.int8).reshape(len(pdf), -1)
                about = c[cell] @ unit + pdf["scale"].to_numpy() * (codes @ unit)
                off = pdf["off"].to_numpy() + 1e-9
                low, high = about - off, about + off
                goal = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                keep = high >= max(goal, -np.inf if least is None else least) - 2e-6
                yield pd.DataFrame({key: pdf[key].to_numpy()[keep], "cell": cell[keep], "low": low[keep], "high": high[keep]})

        kind = dict(rows.dtypes)[key]
        told = rows.select(key, "cell", "code", "scale", "off").mapInPandas(bounds, f"`{key}` {kind}, cell int, low double, high double")
        goal = told.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("goal_"), F.count("*").alias("n_"))
        chance = told.join(F.broadcast(goal)).where((F.col("n_") < k) | (F.col("high") >= F.col("goal_") - 2e-6)).select(key, "cell")
        literal = F.array(*[F.lit(float(v)) for v in unit])
        dot = F.aggregate(F.zip_with("vector", literal, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        full = rows.drop("code", "scale", "off", "d").join(chance, [key, "cell"], "left_semi").withColumn("score", F.round(dot, 6)).drop("vector", "cell")
        return full if least is None else full.where(F.col("score") >= least)

    def search_many(self, queries: DataFrame, query_key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, score, rank) for a table of queries: each goes to its `probes` nearest cells, and a cell's queries meet its vectors in blocks.

        Blocks of 256 queries and of 2048 vectors of a cell are what a task holds;
        per pair of blocks k rows a query go on.
        """
        refuse_others(queries, vector, self.dims)
        c, used, key, probes = self.centroids, np.flatnonzero(self.radius >= 0), self.key, probes or self.probes
        kinds = dict(queries.dtypes)[query_key], dict(self.vectors().dtypes)[key]

        def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                # A query goes on once for each of its cells: some queries at a time.
                step = max(1, SENT_ROWS // max(1, min(probes, len(used))))
                for a in range(0, len(pdf), step):
                    x = _unit(np.stack(pdf["v_"].iloc[a : a + step].to_numpy()).astype(float))
                    near = used[np.argsort(cells_.squared(x, c[used]), axis=1)[:, :probes]]
                    i = np.repeat(np.arange(len(x)), near.shape[1])
                    yield pd.DataFrame({"q": pdf["q"].to_numpy()[a + i], "cell": near.ravel().astype(np.int32), "x": [x[j].tobytes() for j in i]})

        q = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v_")).mapInPandas(sent, f"q {kinds[0]}, cell int, x binary")
        v = self.vectors().select("cell", F.col(key).alias("i"), F.col("vector").alias("x"))

        def packed(rows: DataFrame, name: str, size: int, kind: str) -> DataFrame:
            def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for cell, part in pdf.groupby("cell"):
                        for a in range(0, len(part), size):
                            x = part["x"].iloc[a : a + size]
                            yield pd.DataFrame({"cell": [cell], f"{name}s": [part[name].iloc[a : a + size].tolist()], f"x{name}": [b"".join(y if isinstance(y, bytes) else np.asarray(y, float).tobytes() for y in x)]})

            return rows.mapInPandas(pack, f"cell int, {name}s array<{kind}>, x{name} binary")

        dealt = q.repartition("cell", F.pmod(F.xxhash64("q"), F.lit(4))).sortWithinPartitions("cell")
        met = packed(dealt, "q", 256, kinds[0]).join(packed(v, "i", 2048, kinds[1]), "cell")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    x, y = (np.frombuffer(row[n]).reshape(-1, c.shape[1]) for n in ("xq", "xi"))
                    s = np.round(x @ y.T, 6)
                    ids = np.asarray(row["is"])
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    yield pd.DataFrame({query_key: np.repeat(np.asarray(row["qs"]), order.shape[1]), key: ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

        best = met.mapInPandas(score, f"`{query_key}` {kinds[0]}, `{key}` {kinds[1]}, score double")
        w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, query_key: str, key: str) -> DataFrame:
    """(queries, recall): the mean share of the true neighbours that were found."""
    hit = truth.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    each = hit.groupBy(query_key).agg((F.count("hit") / F.count("*")).alias("r"))
    return each.agg(F.count("*").alias("queries"), F.avg("r").alias("recall"))
