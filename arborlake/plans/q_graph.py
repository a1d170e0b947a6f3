"""Graphs: suppliers as authors, orders as papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import cut
from .registry import query

_M = "m AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS o FROM lineitem)"
_P = f"{_M}, p AS (SELECT DISTINCT a.s AS u, b.s AS v FROM m a JOIN m b ON a.o = b.o AND a.s < b.s)"
_N = "n AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p)"


def members(t):
    return t("lineitem").select("l_suppkey", "l_orderkey").distinct()


def shared(t):
    """(u, v, n): suppliers of common orders, u < v."""
    return graph.shared_groups(t("lineitem"), "l_suppkey", "l_orderkey")


def pairs(t):
    return shared(t).select("u", "v")


@query("graph_edges", "SELECT l_suppkey, l_orderkey FROM lineitem GROUP BY 1, 2")
def graph_edges(t):
    return members(t)


@query("graph_counts", f"WITH {_M} SELECT count(DISTINCT s) AS authors, count(DISTINCT o) AS papers, count(*) AS edges FROM m")
def graph_counts(t):
    return members(t).agg(F.countDistinct("l_suppkey").alias("authors"), F.countDistinct("l_orderkey").alias("papers"), F.count("*").alias("edges"))


@query("top_authors", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def top_authors(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("collaborators", f"WITH {_M} SELECT a.s AS author, count(DISTINCT b.s) AS n FROM m a JOIN m b ON a.o = b.o AND a.s <> b.s GROUP BY 1")
def collaborators(t):
    return graph.degrees(pairs(t)).select(F.col("node").alias("author"), F.col("degree").alias("n"))


@query("pair_strength", f"WITH {_M} SELECT a.s AS a, b.s AS b, count(*) AS n FROM m a JOIN m b ON a.o = b.o AND a.s <> b.s GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 100")
def pair_strength(t):
    often = shared(t).where("n > 1")
    both = often.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("p"), "n")
    return both.select("p.a", "p.b", "n").orderBy(F.desc("n"), "a", "b").limit(100)


@query("co_category", "WITH c AS (SELECT DISTINCT p_partkey AS k, unnest([p_brand, p_type]) AS c FROM part) SELECT a.c AS a, b.c AS b, count(*) AS n FROM c a JOIN c b ON a.k = b.k AND a.c < b.c GROUP BY 1, 2")
def co_category(t):
    c = t("part").select("p_partkey", F.explode(F.array("p_brand", "p_type")).alias("c"))
    return graph.co_members(c, "c", "p_partkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("degree_density", f"WITH {_P}, {_N}, d AS (SELECT u, count(*) AS d FROM n GROUP BY 1) SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, round(avg(d), 6) AS avg_degree, round(2 * (sum(d) / 2) / (count(*) * (count(*) - 1)), 9) AS density FROM d")
def degree_density(t):
    return graph.summary(pairs(t))


@query(
    "degree_centrality",
    f"WITH {_P}, {_N} SELECT u AS node, count(*) AS degree, round(count(*) / ((SELECT count(DISTINCT u) FROM n) - 1), 6) AS centrality FROM n GROUP BY 1",
)
def degree_centrality(t):
    d = cut(graph.degrees(pairs(t)))
    return d.join(F.broadcast(d.agg(F.count("*").alias("n")))).select("node", "degree", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality"))


@query(
    "clustering_coeff",
    f"WITH {_P}, {_N}, d AS (SELECT u, count(*) AS d FROM n GROUP BY 1), tr AS (SELECT x.u AS node, count(*) AS t FROM n x JOIN n y ON x.u = y.u AND x.v < y.v JOIN p ON p.u = x.v AND p.v = y.v GROUP BY 1) SELECT d.u AS node, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN tr ON tr.node = d.u",
)
def clustering_coeff(t):
    return graph.clustering(pairs(t)).withColumn("coefficient", F.round("coefficient", 6))


_WHOLE = "p AS (SELECT DISTINCT o_custkey AS u, -o_orderkey AS v FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL)"


@query(
    "components",
    f"WITH RECURSIVE {_WHOLE}, {_N}, r(node, reach) AS (SELECT DISTINCT u, u FROM n UNION SELECT r.node, n.v FROM r JOIN n ON r.reach = n.u) SELECT node, min(reach) AS component FROM r GROUP BY 1",
)
def components(t):
    return graph.components(whole_pairs(t))


@query(
    "shortest_path",
    f"WITH RECURSIVE {_WHOLE}, {_N}, src AS (SELECT min(u) AS s FROM p), r(node, hops) AS (SELECT s, 0 FROM src UNION SELECT n.v, r.hops + 1 FROM r JOIN n ON r.node = n.u WHERE r.hops < 4) SELECT node, min(hops) AS hops FROM r GROUP BY 1",
)
def shortest_path(t):
    p = whole_pairs(t)
    return graph.shortest_paths(p, p.agg(F.min("u")).first()[0], 4)


_PR = ", ".join(f"r{i + 1} AS (SELECT nodes.node, 0.15 + 0.85 * coalesce(sum(r.rank / o.n), 0) AS rank FROM nodes LEFT JOIN e ON e.t = nodes.node LEFT JOIN r{i} r ON r.node = e.s LEFT JOIN o ON o.s = e.s GROUP BY 1)" for i in range(10))


@query(
    "pagerank",
    f"WITH e AS (SELECT DISTINCT o_custkey % 200 AS s, o_orderkey % 211 AS t FROM orders), o AS (SELECT s, count(*) AS n FROM e GROUP BY 1), nodes AS (SELECT s AS node FROM e UNION SELECT t FROM e), r0 AS (SELECT node, 1.0 AS rank FROM nodes), {_PR} SELECT node, round(rank, 6) AS rank FROM r10",
)
def pagerank(t):
    e = t("orders").select((F.col("o_custkey") % 200).alias("s"), (F.col("o_orderkey") % 211).alias("t"))
    return graph.pagerank(e, "s", "t", 10).withColumn("rank", F.round("rank", 6))


@query("top_cited", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15")
def top_cited(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(15)


def whole_pairs(t):
    """All customers and orders; an order's node is its negated key."""
    return t("orders").select(F.col("o_custkey").cast("long").alias("u"), (-F.col("o_orderkey")).cast("long").alias("v")).where("u is not null and v is not null").distinct()


_ROUNDS = ", ".join(
    f"v{i} AS (SELECT n.u, l.c, count(*) AS k FROM n JOIN l{i} l ON n.v = l.node GROUP BY 1, 2), l{i + 1} AS (SELECT u AS node, c FROM v{i} QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC, c) = 1)" for i in range(5)
)


@query("label_propagation", f"WITH {_WHOLE}, {_N}, l0 AS (SELECT DISTINCT u AS node, u AS c FROM n), {_ROUNDS} SELECT node, c AS community FROM l5")
def label_propagation(t):
    return graph.label_propagation(whole_pairs(t))


@query("betweenness")
def betweenness(t):
    return graph.betweenness_of_all(whole_pairs(t))
