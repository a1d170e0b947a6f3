"""Hierarchical density clusters: mutual reachability, a spanning tree by joins, a condensed tree with stabilities.

1. Each point's k nearest neighbours, exact, by cells (`cells.neighbours`); its
   core distance is that to the `min_samples`-th of them. Two points are as far
   apart as the largest of their core distances and their distance.
2. A minimum spanning tree by Boruvka rounds: every component takes its least
   edge to another, from the neighbour lists. A list ends at its k-th distance;
   where that is less than the edge found, the component's points are compared
   with the cells that may hold something nearer.
3. Edges in ascending order, in ranges of `edges_a_task` at most, merge points to
   a tree: all edges of one weight merge at once, so that ties leave no choice.
   In a range, each connected part is a task's own.
4. Merges with two parts of `min_cluster_size` or more split a cluster, smaller
   parts fall out of it; clusters with more stability than what they split into
   are selected, all by joins, pointer jumping and sums along paths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import cells as cells_
from . import graph

#: Edges of a range, which one task may get; the least weight that a density is the inverse of.
EDGES_A_TASK, LEAST_WEIGHT = 1_000_000, 1e-9
_NODE = "struct<rep:bigint,w:double>"


def spanning_tree(cells: cells_.Cells, near: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w): the edges of a minimum spanning tree of mutual reachability. near: (id, other, d), at least min_samples a point where there are so many."""
    ranked = near.groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    core = ranked.select("id", F.coalesce(F.get("ds", F.lit(min_samples - 1)), F.element_at("ds", -1)).alias("core"), F.element_at("ds", -1).alias("bound"))
    points = cells.packed.select(F.explode("ids").alias("id")).join(core, "id", "left").na.fill(0.0)
    points = cut(points.withColumn("comp", F.col("id")))
    parts, edges = points.count(), []
    while parts > 1:
        found = _least_listed(points, near)
        # What a list does not name is at least as far as its end; equal distances may hide behind it.
        known = points.groupBy("comp").agg(F.min("bound").alias("bound"), F.count("*").alias("size")).join(found, "comp", "left")
        known = cut(known.withColumn("sure", F.coalesce(F.col("best.w") < F.col("bound"), F.lit(False))))
        sure = known.where("sure").select("comp", "best")
        if 2 * sure.count() < parts:
            # Every component but the largest one looks further; that one is found by others.
            largest = known.agg(F.max(F.struct("size", "comp")).alias("m")).head()["m"]["comp"]
            rest = known.where((F.col("comp") != largest) & ~F.col("sure"))
            limit = F.coalesce("best.w", F.lit(float("inf")))
            open_ = points.join(rest.select("comp", limit.alias("limit")), "comp", "left").withColumn("limit", F.when(F.col("bound") <= F.col("limit"), F.col("limit")).otherwise(-1.0))
            more = _least_beyond(cells, cut(open_.select("id", "comp", "core", "limit")))
            found = sure.unionByName(rest.where("best is not null").select("comp", "best")).unionByName(more).groupBy("comp").agg(F.min("best").alias("best"))
        else:
            found = sure
        found = cut(found)
        edges.append(found.select("best.a", "best.b", "best.w").distinct())
        # Every component points along its edge; of two that point at each other, the smaller is the end, and so is one without an edge.
        to = known.select("comp").join(found, "comp", "left").select("comp", F.coalesce(F.when(F.col("best.ca") == F.col("comp"), F.col("best.cb")).otherwise(F.col("best.ca")), "comp").alias("to"))
        back = to.select(F.col("comp").alias("to"), F.col("to").alias("back"))
        ends = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to"))
        label = _jumped(cut(to.join(back, "to").select(F.col("comp").alias("node"), F.when(ends, F.col("comp")).otherwise(F.col("to")).alias("to"))))
        points = cut(points.join(label.withColumnRenamed("node", "comp"), "comp").withColumn("comp", F.col("to")).drop("to"))
        parts = points.select("comp").distinct().count()
    out = points.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("w")).limit(0)
    for e in edges:
        out = out.unionByName(e)
    return cut(out.distinct())


def _edge(a: str, b: str) -> list:
    """An edge's columns in the order by which all components choose: weight, then ends."""
    return [F.col("w"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(F.col(a) < F.col(b), F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(F.col(a) < F.col(b), F.col("cb")).otherwise(F.col("ca")).alias("cb")]


def _least_listed(points: DataFrame, near: DataFrame) -> DataFrame:
    """(comp, best): each component's least edge to another one among the neighbour lists."""
    one = points.select(F.col("id").alias("i"), F.col("core").alias("core_i"), F.col("comp").alias("ca"))
    two = points.select(F.col("id").alias("j"), F.col("core").alias("core_j"), F.col("comp").alias("cb"))
    met = near.select(F.col("id").alias("i"), F.col("other").alias("j"), "d").join(one, "i").join(two, "j").where("ca <> cb")
    edge = met.withColumn("w", F.greatest("d", "core_i", "core_j")).select(F.struct(*_edge("i", "j")).alias("best"))
    return edge.select(F.explode(F.array("best.ca", "best.cb")).alias("comp"), "best").groupBy("comp").agg(F.min("best").alias("best"))


def _least_beyond(cells: cells_.Cells, points: DataFrame) -> DataFrame:
    """(comp, best): the least edges of open points (limit >= 0) to other components, up to their limit, from the cells within it."""
    tiles = cells_.told(cells, points, {"comp": 0, "core": 0.0, "limit": -1.0})
    c, radius = cells.centroids, cells.radius

    def kernel(one: dict, two: dict) -> pd.DataFrame:
        mine = np.flatnonzero(one["limit"] >= 0)
        mine = mine[np.argsort(one["comp"][mine], kind="stable")]
        ids, x, comp, core, limit = (one[v][mine] for v in ("ids", "x", "comp", "core", "limit"))
        # Of each component, the least weight that was met so far.
        group = np.unique(comp, return_inverse=True)[1]
        least = np.full(len(mine), np.inf)
        np.minimum.at(least, group, limit)
        core2 = two["core"] ** 2
        parts = []
        step = max(1, cells_.AT_ONCE // max(1, len(two["ids"])))
        for a in range(0, len(mine), step):
            s = slice(a, a + step)
            g = group[s]
            reach = np.minimum(limit[s], least[g])
            at = cells_.within(x[s], reach, two, c, radius)
            at = at[two["core"][at] <= reach.max()]
            if not len(at):
                continue
            y = two["x"] if len(at) == len(two["ids"]) else two["x"][at]
            w = cells_.squared(x[s], y)
            np.maximum(w, core2[at], out=w)
            np.maximum(w, core[s, None] ** 2, out=w)
            w[(one["ids"][mine[s]][:, None] == two["ids"][at][None]) | (comp[s, None] == two["comp"][at][None])] = np.inf
            # The fast formula is off by its last digits: all that may tie with the least are compared again.
            slack = 1e-9 * (np.where(np.isfinite(reach), reach, 0) ** 2 + (x[s] * x[s]).sum(axis=1))
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            top = np.minimum.reduceat(w.min(axis=1) + slack, start)
            top = np.minimum(top[np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))], reach**2) + slack
            i, j = np.nonzero((w <= top[:, None]) & np.isfinite(w))
            if not len(i):
                continue
            exact = np.maximum(np.maximum(core[s][i], two["core"][at[j]]), cells_.apart_of(x[s], i, y, j))
            out = pd.DataFrame({"i": ids[s][i], "j": two["ids"][at[j]], "w": exact, "ca": comp[s][i], "cb": two["comp"][at[j]]})
            out["lo"], out["hi"] = np.minimum(out.i, out.j), np.maximum(out.i, out.j)
            out = out.sort_values(["ca", "w", "lo", "hi"]).drop_duplicates("ca")
            np.minimum.at(least, group[np.searchsorted(comp, out.ca.to_numpy())], out.w.to_numpy())
            parts.append(out)
        if not parts:
            return pd.DataFrame({n: np.zeros(0, np.float64 if n == "w" else np.int64) for n in ("i", "j", "w", "ca", "cb")})
        return pd.concat(parts).sort_values(["ca", "w", "lo", "hi"]).drop_duplicates("ca")[["i", "j", "w", "ca", "cb"]]

    some = tiles.where(F.exists("limit", lambda v: v >= 0))
    schema = "i long, j long, w double, ca long, cb long"
    within, beyond = (cells_.pairwise(some, tiles, cells.tiles, kernel, schema, cells.dims, same) for same in (True, False))
    edge = within.unionByName(beyond).select(F.col("ca").alias("comp"), F.struct(*_edge("i", "j")).alias("best"))
    return edge.groupBy("comp").agg(F.min("best").alias("best"))


def merge_tree(points: DataFrame, edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(parent, child, child_size, parent_size) of single linkage; a node is (least id in it, weight at which it came to be), a point (id, -1)."""
    n = edges.count()
    ranges = max(1, -(-n // edges_a_task))
    cuts = sorted({*edges.approxQuantile("w", [i / ranges for i in range(1, ranges)], 0.0)}) if ranges > 1 else []
    label = points.select("id", F.col("id").alias("rep"), F.lit(-1.0).alias("top"), F.lit(1).cast("long").alias("size"))
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = edges.where((F.lit(True) if low is None else F.col("w") > low) & (F.lit(True) if high is None else F.col("w") <= high))
        a, b = (label.select(*[F.col(c).alias(f"{side}_{c}") for c in label.columns]) for side in ("a", "b"))
        e = part.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
        if ranges == 1:
            one = e.select(F.lit(0).alias("g"), "w", *[f"{s}_{c}" for s in ("a", "b") for c in ("rep", "top", "size")])
            return one.groupBy("g").applyInPandas(_merge, f"parent {_NODE}, child {_NODE}, child_size long, parent_size long")
        e = cut(e)
        group = graph.components(e.select(F.least("a_rep", "b_rep").alias("u"), F.greatest("a_rep", "b_rep").alias("v")).distinct()).withColumnRenamed("component", "g")
        e = e.join(group, e.a_rep == group.node).select("g", "w", *[f"{s}_{c}" for s in ("a", "b") for c in ("rep", "top", "size")])
        merges = cut(e.groupBy("g").applyInPandas(_merge, f"parent {_NODE}, child {_NODE}, child_size long, parent_size long"))
        out = merges if out is None else out.unionByName(merges)
        if high is not None:
            # Of a part, the last merge is what later ranges see.
            last = merges.groupBy("parent").agg(F.first("parent_size").alias("s")).select(F.col("parent.rep").alias("rep"), "parent.w", "s")
            last = last.groupBy("rep").agg(F.max(F.struct("s", "w")).alias("m"))
            named = label.join(group.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("g", "rep")).drop("g")
            label = cut(named.join(last, "rep", "left").select("id", "rep", F.coalesce("m.w", "top").alias("top"), F.coalesce("m.s", "size").alias("size")))
    return out


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges along the edges of one connected part, all edges of a weight at once."""
    root: dict[int, int] = {}
    node: dict[int, tuple[int, float, int]] = {}
    for s in ("a", "b"):
        for rep, top, size in zip(pdf[f"{s}_rep"].tolist(), pdf[f"{s}_top"].tolist(), pdf[f"{s}_size"].tolist(), strict=True):
            root[rep], node[rep] = rep, (rep, top, size)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = []
    ordered = pdf.sort_values("w")
    w, a, b = ordered["w"].to_numpy(), ordered["a_rep"].tolist(), ordered["b_rep"].tolist()
    edges = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])).tolist() + [len(w)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        joined: dict[int, list[tuple[int, float, int]]] = {}
        for i in range(lo, hi):
            x, y = sorted((find(a[i]), find(b[i])))
            if x != y:
                root[y] = x
                joined.setdefault(x, [node[x]]).extend(joined.pop(y, None) or [node[y]])
        for x, parts in joined.items():
            size = sum(p[2] for p in parts)
            node[x] = (x, float(w[lo]), size)
            rows += [({"rep": x, "w": float(w[lo])}, {"rep": r, "w": top}, s, size) for r, top, s in parts]
    return pd.DataFrame(rows, columns=["parent", "child", "child_size", "parent_size"])


def _jumped(next_: DataFrame) -> DataFrame:
    """(node, to): where pointers (node, to) end; a node that points to itself is an end."""
    while True:
        far = next_.select(F.col("node").alias("to"), F.col("to").alias("far"))
        after = cut(next_.join(far, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        next_ = after.select("node", "to")
        if not after.where("moved").limit(1).count():
            return next_


def condensed(tree: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """((cluster, parent, stability, size), (node, cluster) of merges with min_cluster_size points or more); a cluster is named by its first node."""
    big = F.col("child_size") >= min_cluster_size
    own = tree.where(F.col("parent_size") >= min_cluster_size).groupBy(F.col("parent").alias("node"))
    nodes = cut(own.agg(F.first("parent_size").alias("size"), F.count_if(big).alias("parts"), F.coalesce(F.sum(F.when(~big, F.col("child_size"))), F.lit(0)).alias("small")))
    up = cut(tree.where(big).select(F.col("child").alias("node"), F.col("parent").alias("above")).join(nodes.select(F.col("node").alias("above"), F.col("parts").alias("split")), "above"))
    first = nodes.join(up, "node", "left")
    of = _jumped(first.select("node", F.when(F.col("split") == 1, F.col("above")).otherwise(F.col("node")).alias("to")))
    of = of.withColumnRenamed("to", "cluster")
    left = F.when(F.col("parts") == 1, F.col("small")).otherwise(F.col("size"))
    gain = nodes.join(of, "node").groupBy("cluster").agg(F.sum(left / F.greatest("node.w", F.lit(LEAST_WEIGHT))).alias("gain"))
    top = nodes.join(up, "node", "left").select(F.col("node").alias("cluster"), "size", "above")
    born = F.when(F.col("above").isNull(), 0.0).otherwise(1 / F.greatest("above.w", F.lit(LEAST_WEIGHT)))
    stable = gain.join(top, "cluster").select("cluster", "above", "size", (F.col("gain") - born * F.col("size")).alias("stability"))
    parent = of.select(F.col("node").alias("above"), F.col("cluster").alias("parent"))
    return cut(stable.join(parent, "above", "left").select("cluster", "parent", "stability", "size")), of


def selected(clusters: DataFrame) -> DataFrame:
    """(cluster, label): the selected cluster that each one belongs to, or null. The root is never selected.

    A cluster's largest child continues its path, other children begin paths of
    their own. They have half the size at most, so paths hang below each other
    in a number of levels that is logarithmic, however deep the tree is. Along a
    path, x = max(stability, x of the next + sum over the other children), and a
    running sum and a running maximum solve that.
    """
    main = clusters.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "cluster"))["cluster"].alias("cluster"))
    up = clusters.join(main.select("cluster", F.lit(True).alias("main")), "cluster", "left")
    path = _jumped(cut(up.select(F.col("cluster").alias("node"), F.when(F.col("main"), F.col("parent")).otherwise(F.col("cluster")).alias("to"))))
    path = path.withColumnsRenamed({"node": "cluster", "to": "top"})
    # Sizes fall along a path.
    on = cut(clusters.join(path, "cluster").select("cluster", "parent", "stability", "size", "top"))
    tops = on.where("cluster = top").select("top", F.col("parent").alias("cluster")).join(on.select("cluster", F.col("top").alias("above")), "cluster", "left").select("top", "above")
    tops = cut(tops)
    levels = [cut(tops.where("above is null").select("top"))]
    while True:
        below = cut(tops.join(levels[-1].select(F.col("top").alias("above")), "above").select("top"))
        if below.isEmpty():
            break
        levels.append(below)
    upward = Window.partitionBy("top").orderBy("size", "cluster").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("top").orderBy("size", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    chosen, value = [], None
    for level in reversed(levels):
        given = on.join(level, "top")
        given = given.withColumn("side", F.lit(0.0)) if value is None else given.join(value, given.cluster == value.of_, "left").withColumn("side", F.coalesce("sum_", F.lit(0.0))).drop("of_", "sum_")
        given = given.withColumn("sum_", F.sum("side").over(upward)).withColumn("most", F.coalesce(F.max(F.col("stability") - F.col("sum_")).over(earlier), F.lit(0.0)))
        # Sums in another order differ in their last digits.
        given = given.withColumn("below", F.col("sum_") + F.greatest("most", F.lit(0.0))).withColumn("wins", F.col("stability") >= F.col("below") - 1e-9 * F.abs("below"))
        given = cut(given.select("cluster", "parent", "stability", "size", "top", "below", "wins"))
        chosen.insert(0, given)
        value = given.where("cluster = top").groupBy(F.col("parent").alias("of_")).agg(F.sum(F.greatest("stability", "below")).alias("sum_"))
    out = above = None
    for level in chosen:
        first = level.where("wins and parent is not null").groupBy("top").agg(F.max(F.struct("size", "cluster")).alias("first"))
        told = level.join(first, "top", "left")
        own = F.when(F.col("size") <= F.col("first.size"), F.col("first.cluster"))
        if above is None:
            told = told.select("cluster", own.alias("label"))
        else:
            start = level.where("cluster = top").select("top", "parent").join(above.withColumnsRenamed({"cluster": "parent", "label": "from_"}), "parent").select("top", "from_")
            told = told.join(start, "top").select("cluster", F.coalesce("from_", own).alias("label"))
        above = cut(told)
        out = above if out is None else out.unionByName(above)
    return out


def density_clusters(df: DataFrame, key: str, vector: str, min_cluster_size: int = 5, min_samples: int = 5, k: int | None = None, cells: int | None = None, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(key, cluster): hierarchical density clusters by the stability of the condensed tree; -1 is noise, other labels are the least key in the cluster.

    Keys are unique longs, vectors equally long and finite; rows without a key or
    vector are left out. Noise are points that leave the tree above all selected
    clusters. Fewer points than min_cluster_size are noise, and so is one single
    cluster without any split, as the root is never selected. Points of one
    place have distance 0 and, as a cluster, a stability by LEAST_WEIGHT.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    dealt = cells_.deal(rows, "id", "v", cells)
    near = cells_.neighbours(dealt, max(min_samples, k or 2 * min_samples))
    points = cut(rows.select("id"))
    edges = spanning_tree(dealt, near, min_samples)
    if edges.isEmpty():
        return points.select(F.col("id").alias(key), F.lit(-1).cast("long").alias("cluster"))
    tree = cut(merge_tree(points, edges, edges_a_task))
    clusters, of = condensed(tree, min_cluster_size)
    label = selected(clusters)
    # A point leaves at the first merge of min_cluster_size points or more above it.
    small = tree.select(F.col("child").alias("node"), F.when(F.col("child_size") < min_cluster_size, F.col("parent")).otherwise(F.col("child")).alias("to"))
    tops = tree.select(F.col("parent").alias("node")).distinct().join(tree.select(F.col("child").alias("node")), "node", "left_anti")
    ends = _jumped(cut(small.unionByName(tops.select("node", F.col("node").alias("to")))))
    leaf = ends.where("node.w < 0").select(F.col("node.rep").alias("id"), F.col("to").alias("node"))
    named = leaf.join(of, "node", "left").join(label, "cluster", "left").select("id", "label")
    least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("cluster"))
    out = named.join(least, "label", "left").select("id", "cluster")
    return points.join(out, "id", "left").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
