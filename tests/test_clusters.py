"""Density clusters and communities against plain versions."""

import random

import numpy as np
import plain
import pytest

from arborlake.operators import cells, communities, density


def _points(seed, n, dims, spread):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, dims)) * 4
    x = middle[r.integers(0, 6, n)] + spread * r.normal(size=(n, dims))
    x[: n // 10] = r.uniform(-8, 8, size=(n // 10, dims))  # noise
    return x


def _frame(spark, x, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("count", [1, 12])
def test_neighbours_are_exact(spark, count):
    x = _points(1, 250, 3, 0.6)
    x[10:16] = x[9]
    got = {}
    for r in cells.neighbours(cells.deal(_frame(spark, x), "id", "v", count), 6).collect():
        got.setdefault(r.id, []).append((r.d, r.other))
    for i in range(250):
        d = cells.apart(np.repeat(x[i : i + 1], 250, axis=0), x)
        assert sorted(got[i]) == sorted((d[j], j) for j in range(250) if j != i)[:6]


@pytest.mark.parametrize(("seed", "dims", "size", "samples", "edges_a_task"), [(2, 2, 5, 5, 10**6), (3, 8, 8, 3, 60)])
def test_density_clusters_against_the_definition(spark, seed, dims, size, samples, edges_a_task):
    x = np.round(_points(seed, 150, dims, 0.5), 3 if dims > 2 else 1)  # rounded: many ties and equal points
    ids = [i * 7 - 50 for i in range(150)]
    want = plain.hdbscan(ids, x, size, samples)
    got = {r.id: r.cluster for r in density.density_clusters(_frame(spark, x, ids), "id", "v", size, samples, cells=7, edges_a_task=edges_a_task).collect()}
    assert got == want and len(set(want.values())) > 3 and -1 in want.values()


def test_density_of_few_points(spark):
    x = np.array([[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]])
    assert {r.cluster for r in density.density_clusters(_frame(spark, x), "id", "v").collect()} == {-1}
    assert density.density_clusters(_frame(spark, x).limit(0), "id", "v").count() == 0


def _greedy(edges):
    """Modularity of greedy merging: the pair of communities with the largest gain, while there is one."""
    weight, degree, total = {}, {}, 0.0
    for u, v, w in edges:
        weight[(u, v)] = weight[(v, u)] = weight.get((u, v), 0) + w
    for (u, _), w in weight.items():
        degree[u] = degree.get(u, 0) + w
        total += w
    inside = dict.fromkeys(degree, 0.0)
    while True:
        gains = [(2 * (w / total - degree[u] * degree[v] / total**2), u, v) for (u, v), w in weight.items() if u < v]
        best = max(gains, default=(0, 0, 0))
        if best[0] <= 1e-12:
            return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)
        _, u, v = best
        inside[u] += inside.pop(v) + 2 * weight.pop((u, v))
        weight.pop((v, u))
        degree[u] += degree.pop(v)
        for (a, b), w in list(weight.items()):
            if a == v:
                weight.pop((a, b))
                weight.pop((b, a))
                weight[(u, b)] = weight[(b, u)] = weight.get((u, b), 0) + w


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_are_no_worse_than_greedy_ones(spark, seed):
    r = random.Random(seed)
    n, parts = 60, 5
    edges = {(u, v): float(r.randrange(1, 4)) for u in range(n) for v in range(u + 1, n) if r.random() < (0.5 if u % parts == v % parts else 0.05)}
    df = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, w double")
    found = communities.communities(df, "w").cache()
    both = communities.weighted(df, "w")
    total = sum(edges.values()) * 2
    value = communities.modularity(both, found.withColumnRenamed("community", "c"), total)
    assert value >= _greedy([(u, v, w) for (u, v), w in edges.items()]) - 1e-9
    rows = {x.node: x.community for x in found.collect()}
    assert all(rows[c] == c and c <= i for i, c in rows.items()) and len(rows) == n


def test_communities_of_cliques_and_nothing(spark):
    df = spark.createDataFrame([(a + k, b + k) for k in (0, 10, 20) for a in range(5) for b in range(a)] + [(0, 10), (10, 20), (None, 3)], "u long, v long")
    assert {(r.node, r.community) for r in communities.communities(df).collect()} == {(a + k, k) for k in (0, 10, 20) for a in range(5)}
    assert communities.communities(df.limit(0)).count() == 0


def test_weights_into_communities_are_kept_up_from_the_moved_nodes_edges(spark, monkeypatch):
    r = random.Random(3)
    both = communities.weighted(spark.createDataFrame([(r.randrange(40), r.randrange(40), float(r.randrange(1, 5))) for _ in range(200)], "u long, v long, w double"), "w").cache()
    near = both.where("u <> v").selectExpr("u node", "v c", "w into", "1 links")
    moves = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (7, 7, 2)], "node long, own long, to_ long")
    state = both.selectExpr("u node").distinct().join(moves, "node", "left").selectExpr("node", "coalesce(to_, node) c")
    few = communities._after(near, both, moves, state, 10**6)
    every = communities._after(near, both, moves, state, 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.collect()))
    assert not [r for r in few.collect() if r.c == 1]


def test_vectors_are_compared_in_few_large_tiles(spark):
    x = np.random.default_rng(4).normal(size=(300, 16))  # far apart in all directions: no cell can be ruled out
    dealt = cells.deal(_frame(spark, x), "id", "v", 40)
    assert dealt.packed.count() == dealt.tiles == 1
    dealt = cells.deal(_frame(spark, x), "id", "v", 40, tile_rows=30)
    assert 10 <= dealt.packed.count() <= dealt.tiles <= 40
    near = cells.neighbours(dealt, 10)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 5]
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, total, best = [0], 0.0, w[0].copy()
    best[0] = np.inf
    while len(inside) < 300:
        i = int(best.argmin())
        total += best[i]
        inside.append(i)
        best = np.minimum(best, w[i])
        best[inside] = np.inf
    edges = density.spanning_tree(dealt, near, 5).collect()
    assert len(edges) == 299 and abs(sum(e.w for e in edges) - total) < 1e-6


def test_a_deep_tree_is_selected_from_in_few_steps(spark, monkeypatch):
    r = random.Random(5)
    rows, own = [((0, 1.0), None, 0.0, 1000)], {}
    for i in range(1, 121):  # a cluster of each, and a small one beside it
        rows.append(((i, 1.0), (i - 1, 1.0), r.uniform(0, 30), 1000 - 8 * i))
        rows.append(((1000 + i, 1.0), (i - 1, 1.0), r.uniform(0, 1), 5))
    below: dict = {}
    for c, p, s, _ in reversed(rows):
        own[c] = s >= below.get(c, 0.0)
        below[p] = below.get(p, 0.0) + max(s, below.get(c, 0.0))
    want: dict = {}
    for c, p, _, _ in rows:
        want[c] = None if p is None else want[p] or (c if own[c] else None)
    df = spark.createDataFrame(rows, "cluster struct<rep:bigint,w:double>, parent struct<rep:bigint,w:double>, stability double, size long")
    calls = []
    monkeypatch.setattr(density, "cut", lambda x, f=density.cut: calls.append(1) or f(x))
    got = {tuple(x.cluster): x.label and tuple(x.label) for x in density.selected(df).collect()}
    assert got == want and len(calls) < 30 and len({v for v in want.values() if v}) > 3


@pytest.mark.parametrize("names", ["long", "string"])
def test_held_nodes_move_like_joined_ones(spark, monkeypatch, names):
    r = random.Random(11)
    rows = [(r.randrange(45), r.randrange(45), float(r.randrange(1, 4))) for _ in range(260)] + [(50, 50, 2.0), (60, 61, 1.0), (0, None, 1.0), (7, 8, None)]
    df = spark.createDataFrame(rows, "u long, v long, w double").selectExpr(f"cast(u as {names}) u", f"cast(v as {names}) v", "w")
    monkeypatch.setattr(communities, "EDGES_A_ROW", 20, raising=False)
    monkeypatch.setattr(communities, "EDGES_A_TASK", 60, raising=False)
    sent, kept = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda x: sent.append(1) or kept(x))
    held, few = {x.node: x.community for x in communities.communities(df, "w").collect()}, len(sent)
    monkeypatch.setattr(communities, "HELD_NODES", 0, raising=False)
    sent.clear()
    assert {x.node: x.community for x in communities.communities(df, "w").collect()} == held and len(set(held.values())) > 3
    assert few < len(sent) / 2  # a turn writes nothing
    got = spark.range(-50, 50).selectExpr("xxhash64(id) h", "pmod(xxhash64(id, 5), 4) p").collect()
    assert [x.p == 2 for x in got] == communities._on_turn(np.array([x.h for x in got]), 22, 4).tolist()
