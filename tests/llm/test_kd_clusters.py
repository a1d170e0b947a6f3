import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlake.llm import kd_clusters as kd

SF = "/root/testdata/sf0.001"


def plain(rows, dim, clusters, rounds, scale=64):
    """[(id, cluster, distance, cluster inertia, inertia, digest)] by comparing every vector with every centroid."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(x))) for x in v]))
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in first[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), j) for j, z in enumerate(c))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    each = {}
    for _, d, j in last:
        each[j] = each.get(j, 0) + d
    return [(i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last]


def vectors(dim, n, seed):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + r.gauss(0, 0.1))) for x in r.choice(middles)]) for i in range(n)]
    # One vector many times, ties, and what is not kept.
    rows += [(n + i, rows[0][1]) for i in range(n // 3)] + [(n * 2, [0.0] * dim), (n * 2 + 1, [0.5] * dim)]
    rows += [(7, None), (8, [0.1] * (dim - 1)), (9, [None] + [0.1] * (dim - 1)), (10, [float("nan")] + [0.1] * (dim - 1)), (11, [float("-inf")] + [0.1] * (dim - 1)), (12, []), (None, rows[1][1]), (None, rows[2][1])]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize(("dim", "block"), [(2, 100), (5, 37), (64, 4096)])
def test_clusters_against_plain_rounds(spark, dim, block):
    rows = vectors(dim, 400, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cluster", "distance", "ids", "id_", "v_")}).repartition(3)
    got = sorted(map(repr, (tuple(r) for r in kd.cluster(spark, df, dim=dim, block=block).collect())))
    assert got == sorted(map(repr, plain(rows, dim, 16, 3)))


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(repr, (tuple(r) for r in kd.cluster(spark, df, dim=2).collect()))) == sorted(map(repr, plain(rows, 2, 16, 3)))
    none = kd.cluster(spark, df.where("vec_id > 9"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 2.0**20 + i * 1000.0, float(i)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(repr, (tuple(r) for r in kd.cluster(spark, df, dim=2, block=64).collect()))) == sorted(map(repr, plain(rows, 2, 16, 3)))
    with pytest.raises(Exception, match="beyond a long"):
        kd.cluster(spark, df.select("vec_id", F.array(F.lit(1e30), F.lit(0.0)).alias("embedding")), dim=2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=80), st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=6))
def test_filter_keeps_ties(points, centroids):
    x, c = np.array(points, np.int64), np.array(centroids, np.int64)
    tree, order = kd.build(x, leaf=2)
    want = kd.squared(x, c).argmin(axis=1)
    assert (kd.nearest(tree, c) == want[order]).all()
    count, total = kd.sums(tree, c)
    assert count.tolist() == np.bincount(want, minlength=len(c)).tolist()
    assert all((total[j] == x[want == j].sum(axis=0)).all() for j in range(len(c)))


def test_whole_nodes_are_assigned():
    r = np.random.default_rng(0)
    x = np.concatenate([r.integers(-5, 5, (500, 8)), r.integers(995, 1005, (500, 8))])
    tree, _ = kd.build(x)
    whole, leaves = kd.descend(tree, np.array([[0] * 8, [1000] * 8]))
    assert sum(len(n) for n, _ in whole) == 2 and not sum(len(n) for n, _ in leaves)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    df = kd.op11_kd_clusters(spark, SF)
    want = con.sql(f"select {', '.join(df.columns)} from ({kd.OP11_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 500
