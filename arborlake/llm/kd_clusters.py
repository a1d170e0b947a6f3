"""Centroid clustering of integer vectors by filtering through kd-trees.

Every task packs its vectors into blocks and builds a kd-tree over each: a node
knows its count, the exact sum of its vectors and the box around them. The trees
are written once. A round sends the centroids down all trees: at a node, a
centroid that is strictly farther than another from every point of the box can
win no vector there and is pruned (one that ties somewhere stays), a node with
one centroid left gives it count and sum whole, and at a leaf what is left is
compared exactly. Tasks hand back one sum per centroid and dimension, so a round
shuffles some thousand numbers a task and collects centroids x dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import tidy
from ._scratch import Scratch

DIM, CLUSTERS, ROUNDS = 64, 16, 3
#: Vectors of a tree and of a leaf.
BLOCK, LEAF = 4096, 32
#: Components beyond it have squared distances beyond a long; up to SMALL, doubles hold them exactly.
LARGEST, SMALL = 1 << 27, 1 << 22


@dataclass
class Tree:
    """Vectors in the tree's order, and per node: span of vectors, children (-1: leaf), box and sum."""

    x: np.ndarray
    span: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """(tree, order of the vectors in it). Spans are halved along the box's widest side; equal vectors are one leaf."""
    order = np.arange(len(x))
    span, child, low, high, total = [], [], [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = x[order[a:b]]
        at = len(span)
        span.append((a, b))
        child.append([-1, -1])
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        total.append(own.sum(axis=0))
        if parent >= 0:
            child[parent][side] = at
        width = high[at] - low[at]
        axis = int(width.argmax())
        if b - a > leaf and width[axis]:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
            todo += [(a, a + half, at, 0), (a + half, b, at, 1)]
    tree = Tree(x[order], *(np.array(v, np.int64) for v in (span, child, low, high, total)))
    return tree, order


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= SMALL:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def pruned(low: np.ndarray, high: np.ndarray, c: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of each box that may win a point of it, the one nearest to its middle)."""
    # Twice the middle is whole.
    near = np.where(alive, ((low + high)[:, None] - 2 * c[None]).astype(float).__pow__(2).sum(axis=-1), np.inf)
    best = near.argmin(axis=1)
    z = c[best][:, None]
    away = c[None] - z
    corner = np.where(away > 0, high[:, None], low[:, None])
    # The least of |p - c|^2 - |p - z|^2 over the box, at the corner farthest towards c.
    least = (away * (z + c[None] - 2 * corner)).sum(axis=-1)
    return alive & (least <= 0), best


def descend(tree: Tree, c: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """([(nodes, their one centroid)], [(leaves, centroids left)])."""
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    whole, leaves = [], []
    while len(nodes):
        alive, best = pruned(tree.low[nodes], tree.high[nodes], c, alive)
        one = alive.sum(axis=1) == 1
        whole.append((nodes[one], best[one]))
        nodes, alive = nodes[~one], alive[~one]
        leaf = tree.child[nodes, 0] < 0
        leaves.append((nodes[leaf], alive[leaf]))
        nodes, alive = tree.child[nodes[~leaf]].T.ravel(), np.concatenate([alive[~leaf]] * 2)
    return whole, leaves


def places(span: np.ndarray) -> np.ndarray:
    """The places of all spans (from, to), one after the other."""
    size = span[:, 1] - span[:, 0]
    return np.repeat(span[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def resolved(tree: Tree, c: np.ndarray, leaves: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, nearest centroid, the smaller if tied) of the leaves' vectors, compared with the centroids left there."""
    nodes, alive = (np.concatenate(v) for v in zip(*leaves, strict=True))
    kinds, kind = np.unique(alive, axis=0, return_inverse=True) if len(nodes) else (alive, np.zeros(0, int))
    for i, mask in enumerate(kinds):
        at = places(tree.span[nodes[kind == i]])
        left = np.flatnonzero(mask)
        yield at, left[squared(tree.x[at], c[left]).argmin(axis=1)]


def sums(tree: Tree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the vectors of each centroid."""
    count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
    whole, leaves = descend(tree, c)
    for nodes, best in whole:
        np.add.at(count, best, tree.span[nodes, 1] - tree.span[nodes, 0])
        np.add.at(total, best, tree.total[nodes])
    for at, best in resolved(tree, c, leaves):
        np.add.at(count, best, 1)
        np.add.at(total, best, tree.x[at])
    return count, total


def nearest(tree: Tree, c: np.ndarray) -> np.ndarray:
    """The centroid of each vector, in the tree's order."""
    out = np.zeros(len(tree.x), np.int32)
    whole, leaves = descend(tree, c)
    for nodes, best in whole:
        span = tree.span[nodes]
        out[places(span)] = np.repeat(best, span[:, 1] - span[:, 0])
    for at, best in resolved(tree, c, leaves):
        out[at] = best
    return out


_WIRE = "ids array<long>, x binary, span binary, child binary, low binary, high binary, total binary"


def _trees(vectors: DataFrame, dim: int, scale: int, block: int) -> DataFrame:
    """One row per tree, of rows (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            tree, order = build(np.concatenate([h[1] for h in held]))
            held.clear()
            parts = [tree.x.astype(np.int32), tree.span, tree.child, tree.low.astype(np.int32), tree.high.astype(np.int32), tree.total]
            ids = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([ids, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["ids", "x", "span", "child", "low", "high", "total"])

        for batch in batches:
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, dim)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST / scale} have squared distances beyond a long")
            x = x.astype(np.int64)
            for a in range(0, len(x), block):
                if sum(len(h[1]) for h in held) >= block:
                    yield row()
                held.append((batch.column(0).slice(a, block), x[a : a + block]))
        if held and sum(len(h[1]) for h in held):
            yield row()

    return vectors.mapInArrow(tidy(run), _WIRE)


def _read(batch: pa.RecordBatch, i: int, dim: int) -> Tree:
    x, span, child, low, high, total = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate((np.int32, np.int64, np.int64, np.int32, np.int32, np.int64), 1))
    wide = [v.reshape(-1, dim).astype(np.int64) for v in (x, low, high, total)]
    return Tree(wide[0], span.reshape(-1, 2), child.reshape(-1, 2), *wide[1:])


def _moved(trees: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means; those without vectors stay. Collects centroids x dimensions rows."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                n, s = sums(_read(batch, i, dim), c)
                count += n
                total += s
        cluster, axis = np.divmod(np.arange(k * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cluster, axis, np.repeat(count, dim), total.ravel())], ["cluster", "axis", "n", "s"])

    parts = trees.mapInArrow(tidy(run), "cluster long, axis long, n long, s long")
    out = c.copy()
    for r in parts.groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").collect():
        out[r["cluster"], r["axis"]] = r["s"] // r["n"]
    return out


def _assigned(trees: DataFrame, c: np.ndarray, id_col: str) -> DataFrame:
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _read(batch, i, dim)
                best = nearest(tree, c)
                distance = ((tree.x - c[best]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(best), pa.array(distance)], [id_col, "cluster", "distance"])

    return trees.mapInArrow(tidy(run), f"`{id_col}` long, cluster int, distance long")


def cluster(
    spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = 64, salt: str = "1", block: int = BLOCK
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dim` components, none null, NaN or infinite; a component
    x becomes floor(scale * x). Null vectors and those of other lengths are not
    kept. Centroids start as the vectors with the smallest sha256 of `salt:id`,
    by vector where ids are equal (a null id hashes as `salt:`); with fewer
    vectors than clusters, all of them. Repeated rows are vectors like others.
    Ids are cast to long; other columns are ignored, whatever their names. No
    kept vectors: no rows. A component beyond LARGEST / scale is an error, for
    its distances are no longs.
    """
    scratch = Scratch(spark, "kd")
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    kept = vectors.where((F.size(v) == dim) & finite).select(F.col(id_col).cast("long").alias("id_"), v.alias("v_"))
    whole = F.transform("v_", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    first = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id_").cast("string"), F.lit(""))), 256).alias("h_"), whole.alias("w_"))
    c = np.array([r["w_"] for r in first.orderBy("h_", "w_").limit(clusters).collect()], np.int64).reshape(-1, dim)
    if not len(c):
        c = np.zeros((1, dim), np.int64)
    trees = scratch.table(_trees(kept, dim, scale, block))
    for _ in range(rounds):
        c = _moved(trees, c)
    found = scratch.table(_assigned(trees, c, id_col))
    # One row a cluster.
    sizes = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(i, s, sum(sizes.values()), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, s in sizes.items()]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (
  SELECT r, vec_id, v, c, d FROM (
    SELECT k.r, k.vec_id, k.v, c.c, list_sum(list_transform(range(1, 65), lambda j: (k.v[j] - c.v[j]) * (k.v[j] - c.v[j])))::BIGINT AS d FROM kept k, c{i} c
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""


def _move_sql(i: int) -> str:
    return f"""
s{i} AS (SELECT c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))"""


OP11_SQL = (
    """WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c, v FROM kept
  QUALIFY c < 16
),"""
    + ",".join(_round_sql(i) + "," + _move_sql(i) for i in range(ROUNDS))
    + ","
    + _round_sql(ROUNDS)
    + f"""
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (c)"""
)
