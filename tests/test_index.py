"""Stored postings and vectors, searches over them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import lexical, search, vector_index
from arborlake.operators.postings import PostingsIndex

rng = random.Random(9)


def _docs(n):
    common = ["alpha", "beta", "gamma"]
    rare = [f"rare{i}" for i in range(200)]
    return [(i, " ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randrange(0, 60)))) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(600), "doc_id long, text string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return PostingsIndex.build(docs, "doc_id", "text", str(tmp_path_factory.mktemp("p") / "x"), buckets=4, block=50)


def _plain(docs, terms, k):
    """Scores over a scan of all texts."""
    weights = lexical.idf(lexical.terms(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")))
    q = docs.sparkSession.createDataFrame([(0, t, v) for t, v in terms.items()], "q int, token string, tf double")
    rows = lexical.sparse_scores(q, lexical.terms(docs, "doc_id", "text"), weights, "q", "doc_id").orderBy(F.desc("score"), "doc_id").limit(k).collect()
    return [(r.doc_id, r.score) for r in rows]


@pytest.mark.parametrize("terms", [{"rare3": 1.0}, {"alpha": 1.0, "rare5": 1.7, "rare9": 1.0}, {"alpha": 2.0, "beta": 1.0, "gamma": 1.0}, {"nowhere": 1.0}, {}])
@pytest.mark.parametrize("sharpen", [True, False])
def test_top_documents_from_blocks(docs, index, terms, sharpen):
    got = [(r.doc, r.score) for r in index.top(terms, 10, sharpen=sharpen).collect()]
    assert got == (_plain(docs, terms, 10) if terms else [])


def test_low_blocks_are_not_read(index):
    rows = {r["token"]: (r["idf"], r["max_tf"]) for r in index.tokens().collect()}
    weights = {"alpha": (0.001 * rows["alpha"][0], rows["alpha"][1]), "rare3": rows["rare3"]}
    least = index.levels(weights, 1)
    # The best document has the rare token as often as any; blocks where it is rarer cannot make up for that.
    assert rows["rare3"][1] > least["rare3"] > 1.0
    assert index.levels(weights, 1, sharpen=False)["rare3"] <= least["rare3"] and index.levels(weights, 600)["rare3"] < 1.0
    plan = index.top({"rare3": 1.0}, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "documents" not in plan
    blocks = index._read("postings")
    assert blocks.agg(F.max("n")).first()[0] <= 100 and blocks.where("token = 'alpha'").count() > 5


def test_postings_within_a_filter_and_many_queries(docs, index):
    some = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"))
    got = [r.doc for r in index.top({"alpha": 1.0, "rare7": 1.0}, 8, within=some).collect()]
    assert got == [d for d, _ in _plain(docs, {"alpha": 1.0, "rare7": 1.0}, 700) if d % 3 == 0][:8]
    q = docs.sparkSession.createDataFrame([(1, "alpha rare7"), (2, "rare9 rare9")], "item long, words string")
    many = {(r["item"], r["doc"]): r["score"] for r in index.scores(q, "item", "words").collect()}
    assert all(many[(1, d)] == s for d, s in _plain(docs, {"alpha": 1.0, "rare7": 1.0}, 20)) and {i for i, _ in many} == {1, 2}


DIMS = 16


def _vectors(n):
    r = np.random.default_rng(4)
    middle = r.normal(size=(12, DIMS))
    x = middle[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, DIMS))
    x[5] = x[6] * 3
    x[7] = 0
    return [(i, v.tolist(), int(i % 4)) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(_vectors(900), "vec_id long, v array<double>, label int")


@pytest.fixture(scope="module")
def ivf(vectors, tmp_path_factory):
    return vector_index.VectorIndex.build(vectors, "vec_id", "v", str(tmp_path_factory.mktemp("v") / "x"), DIMS, "model a", cells=25, payload=("label",))


def _nearest(q, k, keep=lambda i: True, least=-2.0):
    rows = [(i, np.array(v)) for i, v, _ in _vectors(900) if any(v) and keep(i)]
    s = [(-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6), i) for i, v in rows]
    return [(i, -x) for x, i in sorted(s) if -x >= least][:k]


@pytest.mark.parametrize("probes", [1, 4, 25])
def test_exact_search(ivf, probes):
    for i in (0, 5, 33):
        q = np.array(_vectors(900)[i][1])
        got = ivf.search(q, 12, probes=probes, exact=True).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [j for j, _ in _nearest(q, 12)] and [r["rank"] for r in got] == list(range(1, 13))


def test_filter_and_threshold(ivf):
    q = np.array(_vectors(900)[10][1])
    got = ivf.search(q, 50, probes=2, where=F.col("label") == 1, least=0.8, exact=True).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [j for j, _ in _nearest(q, 50, lambda i: i % 4 == 1, 0.8)] and got and all(r.label == 1 for r in got)


def test_probes_prune_partitions_and_reach_recall(ivf, vectors):
    q = vectors.where("vec_id % 9 = 1").select(F.col("vec_id").alias("q"), "v")
    truth = ivf.search_many(q, "q", "v", 10, probes=25)
    want = {(i, j, s) for i in range(1, 900, 9) for j, s in _nearest(np.array(_vectors(900)[i][1]), 10)}
    assert {(r.q, r.vec_id, r.score) for r in truth.collect()} == want
    assert 1 <= ivf.probes < 25 and vector_index.recall(ivf.search_many(q, "q", "v", 10), truth, "q", "vec_id").first()["recall"] >= 0.9
    plan = ivf.search([1.0] * DIMS, 5, probes=3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert ivf.status().first()["vectors"] == 899


def test_index_refuses_what_does_not_fit(spark, ivf, vectors, tmp_path):
    with pytest.raises(vector_index.IndexMismatch, match="dims"):
        vector_index.VectorIndex.open(spark, ivf.path, dims=8)
    with pytest.raises(vector_index.IndexMismatch, match="new path"):
        vector_index.VectorIndex.open(spark, ivf.path, model="model b")
    with pytest.raises(vector_index.IndexMismatch):
        ivf.search([1.0] * 8, 3)
    bad = spark.createDataFrame([(1, [1.0] * DIMS), (2, [1.0] * 3), (3, None), (4, [float("nan")] * DIMS)], "vec_id long, v array<double>")
    with pytest.raises(vector_index.IndexMismatch, match="3 vectors"):
        vector_index.VectorIndex.build(bad, "vec_id", "v", str(tmp_path / "y"), DIMS)
    assert ivf.search([0.0] * DIMS, 3, exact=True).count() == 0


def test_research_search_and_reasons(spark, ivf, index):
    q = np.array(_vectors(900)[20][1])
    found = search.research_search(ivf, q, 5, index, {"alpha": 1.0, "rare7": 1.0})
    assert found.hits.count() == 5 and found.status.first()["result_status"] == "matches"
    none = search.research_search(ivf, q, 5, where=F.col("label") == 99).status.first()
    assert (none["eligible"], none["returned"], none["result_status"], none["no_match_reason"]) == (0, 0, "no_match", "nothing passes the filter")
    far = search.research_search(ivf, -q, 5, min_relevance=1.0).status.first()
    assert far["result_status"] == "no_match" and far["no_match_reason"].startswith("no candidate reached 1.000; the best had 0.")
    dense = search.research_search(ivf, q, 5, where=F.col("label") < 2)
    assert [r.vec_id for r in dense.hits.orderBy("rank").collect()] == [i for i, _ in _nearest(q, 5, lambda i: i % 4 < 2)]
    with pytest.raises(ValueError):
        search.research_search(ivf, q, min_relevance=2.0)
    meta = spark.createDataFrame([(20, "twenty")], "doc_id long, title string")
    rows = {r.doc_id: r.title for r in search.semantic_search(ivf, q, meta, "doc_id", 4).collect()}
    assert len(rows) == 4 and rows[20] == "twenty" and list(rows.values()).count(None) == 3
