"""What a Python worker holds must not grow with queries x vectors or queries x cells."""

import tracemalloc

import numpy as np
import pandas as pd

from arborlake.operators import postings, vector, vector_index


def test_scores_of_a_block_are_held_a_few_rows_at_a_time():
    rng = np.random.default_rng(3)
    m, v, k = rng.integers(-2, 3, (1500, 4)).astype(float), rng.integers(-2, 3, (6000, 4)).astype(float), 5
    unit, unit_v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (m, v))
    keys = rng.permutation(len(v))
    batches = [(keys[a : a + 3000], pd.Series(list(v[a : a + 3000]))) for a in (0, 3000)]
    tracemalloc.start()
    ((names, found, scores),) = vector.best_of(iter(batches), np.arange(len(m)), unit, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for q in range(0, len(m), 97):
        s = np.round(unit_v @ unit[q], 6)
        order = np.lexsort((keys, -s))[:k]
        assert found[names == q].tolist() == keys[order].tolist() and np.allclose(scores[names == q], s[order])


def test_a_query_is_sent_to_its_cells_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SENT_ROWS", 40, raising=False)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id long, v array<double>").coalesce(1)
    index = vector_index.VectorIndex.build(rows, "id", "v", str(tmp_path / "i"), 4, cells=20)
    seen = pd.DataFrame({"q": np.arange(50), "v_": [rng.normal(size=4) for _ in range(50)]})
    kernels = []
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, f, schema, *a, **k: kernels.append(f) or spark.createDataFrame([], schema))
    index.search_many(rows.withColumnRenamed("id", "query"), "query", "v", 3, probes=20)
    sizes = [len(x) for x in kernels[0](iter([seen]))]
    assert max(sizes) <= 40 and sum(sizes) == 50 * len(np.flatnonzero(index.radius >= 0))


def test_the_texts_are_tokenised_once_for_the_postings(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"word{(i * j) % 17}" for j in range(i % 9))) for i in range(120)] + [(200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, cut, reads = spark.read.parquet(str(tmp_path / "docs")), postings.cut, []
    monkeypatch.setattr(postings, "cut", lambda df: reads.append(any("/docs/" in f for f in df.inputFiles())) or cut(df))
    monkeypatch.setattr(postings, "CHARS_A_TASK", 300, raising=False)
    index = postings.PostingsIndex.build(docs, "doc_id", "text", str(tmp_path / "x"), buckets=2, block=10)
    assert reads.count(True) == 1 and reads.count(False) >= 1
    want = sorted((t, i) for i, x in rows if x for t in set(x.split()))
    blocks = index._read("postings").collect()
    assert sorted((b.token, d) for b in blocks for d in b.docs) == want
    assert len({(b.token, b.tf, b["sub"]) for b in blocks}) == len(blocks)


def test_an_upsert_makes_its_points_once(spark):
    from arborlake.plans import registry

    out = registry.QUERIES["index_upsert"](spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in out.inputFiles())
