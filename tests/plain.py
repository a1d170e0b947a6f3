"""Plain versions of core operators, for small inputs."""

import numpy as np

from arborlake.operators.cells import apart


def reachability(x, min_samples):
    n = len(x)
    d = np.array([apart(np.repeat(x[i : i + 1], n, axis=0), x) for i in range(n)])
    core = np.array([np.sort(np.delete(d[i], i))[min(min_samples, n - 1) - 1] for i in range(n)])
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def parts_below(m, rows, w):
    """Connected parts of rows under edges of less than w."""
    left, out = set(rows), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            i = todo.pop()
            for j in list(left):
                if m[i, j] < w:
                    left.discard(j)
                    part.add(j)
                    todo.append(j)
        out.append(sorted(part))
    return out


def widest(m, rows):
    """The largest edge of a spanning tree of rows."""
    inside, most = {rows[0]}, 0.0
    out = {j: m[rows[0], j] for j in rows[1:]}
    while out:
        j = min(out, key=out.get)
        most = max(most, out.pop(j))
        for i in out:
            out[i] = min(out[i], m[j, i])
        inside.add(j)
    return most


def hdbscan(ids, x, min_cluster_size=5, min_samples=5, least=1e-9):
    """{id: least id of its cluster, or -1}, by the definition: clusters are followed downwards from the whole."""
    m = reachability(x, min_samples)
    clusters = []

    def follow(rows, birth, parent):
        me = len(clusters)
        clusters.append({"members": rows, "stability": 0.0, "parent": parent, "children": []})
        if parent is not None:
            clusters[parent]["children"].append(me)
        now = rows
        while True:
            w = widest(m, now)
            lam = 1 / max(w, least)
            parts = parts_below(m, now, w)
            big = [p for p in parts if len(p) >= min_cluster_size]
            staying = sum(map(len, big)) if len(big) == 1 else 0
            clusters[me]["stability"] += (len(now) - staying) * (lam - birth)
            if len(big) == 1:
                now = big[0]
                continue
            for p in big:
                follow(p, lam, me)
            return

    out = {i: -1 for i in ids}
    if len(ids) < max(2, min_cluster_size):
        return out
    follow(list(range(len(ids))), 0.0, None)

    def best(c):
        below = [best(k) for k in clusters[c]["children"]]
        total = sum(v for v, _ in below)
        if clusters[c]["parent"] is not None and clusters[c]["stability"] >= total - 1e-9 * abs(total):
            return clusters[c]["stability"], [c]
        return max(total, clusters[c]["stability"]), [k for _, ks in below for k in ks]

    for c in best(0)[1]:
        members = [ids[i] for i in clusters[c]["members"]]
        for i in members:
            out[i] = min(members)
    return out
