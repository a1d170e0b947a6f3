"""Vectors dealt into cells around coarse centroids, and tile-by-tile work on pairs of points.

The centroids are fitted on a bounded sample and are the only thing that the
driver and every task hold; the vectors lie in a table of packed tiles, each of
some cells that lie near each other, or of a part of a large one. A cell knows
its radius, so the triangle inequality tells how near its points can be to
another point. Where that rules nothing out, as among many dimensions, all pairs
are compared: in large tiles, a product of matrices at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of the sample that centroids are fitted on, cells at most.
SAMPLE, MAX_CELLS = 20_000, 4096
#: A tile has an ALONG-th of the rows, within these bounds; so many elements are compared at once.
ALONG, LEAST_TILE, MOST_TILE, AT_ONCE = 12, 512, 16_384, 1 << 19
#: Tasks that pairs of tiles are dealt to, at most.
MOST_TASKS = 2000
_PACKED = "tile int, ids array<long>, cells array<int>, x binary"


def fit_centroids(vectors: DataFrame, vector: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Coarse centroids by Lloyd's rounds over a bounded sample; about the square root of the rows, if not said otherwise."""
    n = vectors.count()
    share = min(1.0, 1.2 * sample / max(1, n))
    rows = (vectors if share >= 1 else vectors.sample(share, seed)).select(F.col(vector).cast("array<double>").alias("v")).limit(sample).collect()
    if not rows:
        return np.zeros((1, 1))
    x = np.array([r["v"] for r in rows])
    k = max(1, min(cells or round(n**0.5), len(np.unique(x, axis=0)), MAX_CELLS))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = squared(x, c).argmin(axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T), 0)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x to the same rows of y, to 12 digits, so that equal ones tie."""
    d = np.sqrt(((x - y) ** 2).sum(axis=-1))
    scale = 10.0 ** (11 - np.floor(np.log10(np.where(d > 0, d, 1.0))))
    return np.round(d * scale) / scale


@dataclass
class Cells:
    """Packed vectors (tile, ids, cells, x), the centroids, and each cell's radius. A tile's rows are in the order of their cells."""

    packed: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    tiles: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def deal(vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, tile_rows: int | None = None) -> Cells:
    """Deal (key, vector) rows into cells and tiles. Keys are unique longs, vectors equally long and finite. A large cell is several tiles."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    c = fit_centroids(rows, "v", cells, sample)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                d = squared(x, c)
                yield pd.DataFrame({"cell": d.argmin(axis=1).astype(np.int32), "id": pdf["id"], "x": [r.tobytes() for r in x], "d": np.sqrt(d.min(axis=1))})

    near = cut(rows.mapInPandas(assign, "cell int, id long, x binary, d double"))
    radius, size = np.zeros(len(c)), np.zeros(len(c), int)
    for r in near.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["d"], r["n"]
    first, parts = _tiles(c, size, tile_rows or int(np.clip(-(-size.sum() // ALONG), LEAST_TILE, MOST_TILE)))
    told = rows.sparkSession.createDataFrame(pd.DataFrame({"cell": np.arange(len(c), dtype=np.int32), "first": first, "parts": parts}), "cell int, first int, parts int")
    tile = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("tile")
    dealt = near.join(F.broadcast(told), "cell").select(tile, "cell", "id", "x")
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "cell", "id")
    return Cells(cut(dealt.mapInPandas(_pack, _PACKED)), c, radius, int((first + parts).max()))


def _tiles(c: np.ndarray, size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first tile, number of tiles) of each cell: cells along a chain of near ones fill tiles of about so many rows."""
    first, parts = np.zeros(len(c), np.int32), np.ones(len(c), np.int32)
    left, at, tile, held = np.ones(len(c), bool), 0, 0, 0
    for _ in range(len(c)):
        left[at] = False
        n = int(size[at])
        if held and held + n > rows:
            tile, held = tile + 1, 0
        first[at], parts[at] = tile, max(1, -(-n // rows))
        held += n
        if parts[at] > 1:
            tile, held = tile + int(parts[at]), 0
        if left.any():
            at = int(np.where(left, ((c - c[at]) ** 2).sum(axis=1), np.inf).argmin())
    return first, parts


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[int, int, bytes]] = []
    current = None

    def out() -> pd.DataFrame:
        ids, cells, x = zip(*held, strict=True)
        held.clear()
        return pd.DataFrame({"tile": [current], "ids": [list(ids)], "cells": [list(cells)], "x": [b"".join(x)]})

    for pdf in batches:
        for tile, cell, i, x in zip(pdf["tile"].tolist(), pdf["cell"].tolist(), pdf["id"].tolist(), pdf["x"], strict=True):
            if held and tile != current:
                yield out()
            current = tile
            held.append((i, cell, x))
    if held:
        yield out()


#: A left tile's row and a right tile's (columns as arrays) -> rows
Kernel = Callable[[dict, dict], pd.DataFrame]


def pairwise(left: DataFrame, right: DataFrame, tiles: int, kernel: Kernel, schema: str, dims: int, same: bool) -> DataFrame:
    """kernel over pairs of a left and a right tile (tile, ids, cells, x, further ones, the same in both): each with itself (same), or with all others."""
    columns = left.columns
    far = right.withColumnsRenamed({c: "other_" + c for c in right.columns})
    if same:
        one, two = left.withColumn("to_", F.col("tile")), far.withColumn("from_", F.col("other_tile"))
    else:
        wanted = sorted(r["tile"] for r in left.select("tile").distinct().collect())
        one = left.withColumn("to_", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).where("to_ <> tile")
        two = far.withColumn("from_", F.explode(F.lit(wanted).cast("array<int>"))).where("from_ <> other_tile")
    # Pairs are dealt, not tiles: what meets one tile is not one task.
    parts = min(max(1, tiles if same else tiles**2), MOST_TASKS)
    one, two = one.repartition(parts, "tile", "to_"), two.repartition(parts, "from_", "other_tile")
    met = one.join(two, (F.col("tile") == F.col("from_")) & (F.col("to_") == F.col("other_tile")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = ({c: _array(batch.column(side + c)[i], dims) for c in columns} for side in ("", "other_"))
                yield pa.RecordBatch.from_pandas(kernel(one, two), preserve_index=False)

    return met.select(*columns, *far.columns).mapInArrow(run, schema)


def _array(value: pa.Scalar, dims: int) -> np.ndarray | int:
    if isinstance(value, pa.ListScalar):
        return value.values.to_numpy(zero_copy_only=False)
    return np.frombuffer(value.as_buffer()).reshape(-1, dims) if isinstance(value, pa.BinaryScalar) else value.as_py()


def within(z: np.ndarray, bound: np.ndarray, two: dict, c: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The rows of tile two, in cells where the triangle inequality leaves some row of z something within its bound."""
    cells = np.unique(two["cells"])
    least = np.sqrt(squared(z, c[cells])) - radius[cells] - 1e-6
    return np.flatnonzero(np.isin(two["cells"], cells[(least <= bound[:, None]).any(axis=0)]))


def apart_of(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """apart(x[i], y[j]), some rows at a time."""
    step = 1 << 16
    return np.concatenate([apart(x[i[a : a + step]], y[j[a : a + step]]) for a in range(0, max(1, len(i)), step)])


def neighbours(cells: Cells, k: int) -> DataFrame:
    """(id, other, d): the k nearest other points of each, exactly; of equally near ones the smaller id.

    A point's own tile bounds its k-th distance; then the cells of other tiles
    that may hold a nearer point are searched.
    """
    c, radius = cells.centroids, cells.radius

    def kernel(one: dict, two: dict) -> pd.DataFrame:
        ids, x = one["ids"], one["x"]
        bounds = one["bound"] if "bound" in one else np.full(len(ids), np.inf)
        parts = [pd.DataFrame({"id": ids[:0], "other": ids[:0], "d": np.zeros(0)})]
        step = max(1, AT_ONCE // max(1, len(two["ids"])))
        for a in range(0, len(ids), step):
            own, z, bound = (v[a : a + step] for v in (ids, x, bounds))
            at = within(z, bound, two, c, radius)
            if not len(at):
                continue
            far, y = (two[v] if len(at) == len(two["ids"]) else two[v][at] for v in ("ids", "x"))
            d = squared(z, y)
            d[own[:, None] == far[None]] = np.inf
            last = bound[:, None] ** 2
            if not np.isfinite(last).all():
                width = min(k, d.shape[1])
                last = np.minimum(last, np.partition(d, width - 1, axis=1)[:, width - 1 : width])
            # The fast formula is off by its last digits: all that may tie with the k-th are compared again.
            slack = 1e-9 * (np.where(np.isfinite(last), last, 0) + (z * z).sum(axis=1)[:, None])
            i, j = np.nonzero(np.isfinite(d) & (d <= last + slack))
            exact = apart_of(z, i, y, j)
            order = np.lexsort((far[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            parts.append(pd.DataFrame({"id": own[i[nth < k]], "other": far[j[nth < k]], "d": exact[nth < k]}))
        return pd.concat(parts)

    schema = "id long, other long, d double"
    found = cut(pairwise(cells.packed, cells.packed, cells.tiles, kernel, schema, cells.dims, True))
    ends = found.groupBy("id").agg(F.max("d").alias("d"), F.count("*").alias("c"))
    bound = F.when(F.col("c") >= k, F.col("d")).otherwise(float("inf")).alias("bound")
    more = pairwise(told(cells, ends.select("id", bound), {"bound": float("inf")}), told(cells, None, {"bound": 0.0}), cells.tiles, kernel, schema, cells.dims, False)
    return cut(_best(found.unionByName(more), k))


def told(cells: Cells, points: DataFrame | None, columns: dict[str, float]) -> DataFrame:
    """The tiles with columns of (id, further ones), in the order of their ids; the value given where a point has none."""
    if points is None:
        return cells.packed.select("*", *[F.array_repeat(F.lit(v), F.size("ids")).alias(n) for n, v in columns.items()])
    spread = cells.packed.select("tile", F.posexplode("ids").alias("at", "id")).join(points, "id", "left").na.fill(columns)
    lists = spread.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("at", *columns))).alias("t"))
    return cut(cells.packed.join(lists, "tile").select("tile", "ids", "cells", "x", *[F.col(f"t.{n}").alias(n) for n in columns]))


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return rows.withColumn("r_", rank).where(F.col("r_") <= k).drop("r_")
