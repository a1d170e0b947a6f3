"""Merge on read, and pages as a stream."""

import random

import pytest

from arborlake.operators import delta, versions
from arborlake.sources import pages

SCHEMA = "k int, v int, t string, x string"


def _plain(batches):
    """(current, all versions) of a table that is updated row by row."""
    rows = {}
    for batch in batches:
        best = {}
        for k, v, t, x in batch:
            at = (k, -1 if v is None else v)
            order = (t is not None, t or "", v is not None, x is not None, x or "")
            if at not in best or order > best[at][0]:
                best[at] = order, (v, t, x)
        for at, (_, new) in best.items():
            old = rows.get(at, (None, None, None))
            rows[at] = tuple(b if b is not None else a for a, b in zip(old, new, strict=True))
    top = {}
    for k, v in rows:
        top[k] = max(top.get(k, -9), v)
    return {(k, *rows[k, v]) for k, v in top.items()}, {(k, *row) for (k, v), row in rows.items()}


def test_merge_on_read(spark, tmp_path):
    rng = random.Random(5)
    table = delta.MergeTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "v", ["t"], buckets=8)
    assert table.current().count() == 0 and table.compact() == 0
    done = []
    for i in range(5):
        rows = [(rng.choice([None, *range(12)]), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([None, "p", "q"])) for _ in range(25)]
        assert table.append(spark.createDataFrame(rows, SCHEMA), i)
        # A batch that is run again adds nothing.
        assert not table.append(spark.createDataFrame(rows, SCHEMA), i)
        done.append(rows)
        if i in (1, 3):
            touched = {b for of in table.state()["deltas"].values() for b in of}
            assert table.compact() == len(touched) > 0 and not table.state()["deltas"]
        current, every = _plain(done)
        assert {tuple(r) for r in table.current().collect()} == current
        assert {tuple(r) for r in table.versions().collect()} == every
        assert {tuple(r) for r in table.archive().collect()} == every - current
    keys = spark.createDataFrame([(3,), (4,), (3,)], "k int")
    assert {tuple(r) for r in table.current(keys).collect()} == {r for r in current if r[0] in (3, 4)}
    bucket = touched.pop()
    files = table._stored(table.state(), {bucket}).inputFiles()
    assert files and all(f"/b_={bucket}/" in f for f in files)
    table.compact()
    assert table.vacuum() > 0 and {tuple(r) for r in table.current().collect()} == current


def test_current_rows_are_those_of_an_upsert(spark, tmp_path):
    rng = random.Random(6)
    table = delta.MergeTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "v", ["t", "x"])
    current = archive = spark.createDataFrame([], SCHEMA)
    for _ in range(3):
        batch = spark.createDataFrame([(rng.randrange(6), rng.choice([1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([None, "p", "q"])) for _ in range(8)], SCHEMA)
        table.append(batch)
        current, archive = (spark.createDataFrame(df.collect(), SCHEMA) for df in versions.upsert(current, archive, batch, ["k"], "v", ["t", "x"]))
    assert sorted(map(str, table.current().collect())) == sorted(map(str, current.collect()))


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    table = delta.MergeTable(spark, f"file://{tmp_path}/t", "k long, v int", ["k"], "v", buckets=16)
    table.append(spark.range(5000).selectExpr("id AS k", "1 AS v"))
    table.compact()
    base = set(table.state()["base"].values())
    table.append(spark.createDataFrame([(7, 2)], "k long, v int"))
    state = table.state()
    assert set(state["base"].values()) == base and [len(b) for b in state["deltas"].values()] == [1]
    # Only the bucket that the delta touches is written again.
    assert table.compact() == 1 and base & set(table.state()["base"].values()) == base
    assert table.current().count() == 5000 and [tuple(r) for r in table.archive().collect()] == [(7, 1)]


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    a, b = (delta.MergeTable(spark, f"file://{tmp_path}/t", "k int, v int", ["k"], "v") for _ in range(2))
    seen = b.state()
    a.append(spark.createDataFrame([(1, 1)], "k int, v int"))
    with monkeypatch.context() as m:
        m.setattr(b, "state", lambda: seen)
        with pytest.raises(delta.CommitConflict):
            b.append(spark.createDataFrame([(2, 1)], "k int, v int"))
    assert [tuple(r) for r in b.current().collect()] == [(1, 1)]
    assert b.append(spark.createDataFrame([(2, 1)], "k int, v int")) and b.vacuum() == 1 and b.current().count() == 2


def test_late_versions_as_a_stream(spark, tmp_path):
    table = delta.MergeTable(spark, f"file://{tmp_path}/t", "k int, v int, t string", ["k"], "v", ["t"], buckets=4)
    for rows in ([(1, 2, "b")], [(1, 1, "a"), (2, None, "x")], [(2, 1, "y")]):
        spark.createDataFrame(rows, table.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        delta.merge_stream(spark, f"{tmp_path}/in", table, f"{tmp_path}/ck", compact_after=2)
    assert {(r.k, r.v) for r in table.current().collect()} == {(1, 2), (2, 1)}
    assert {(r.k, r.v) for r in table.archive().collect()} == {(1, 1), (2, None)}


def _service(folder, results, fails=(), short=None):
    """A fake service over the numbers below `results` of each topic; calls are written to files, and those in `fails` fail the first time."""
    import os
    import uuid

    def fetch(topic, start, size):
        seen = [f for f in os.listdir(folder) if f.startswith(f"{topic}-{start}-")]
        open(f"{folder}/{topic}-{start}-{uuid.uuid4().hex}", "w").close()
        if (topic, start) in fails and not seen:
            raise OSError("busy")
        n = results[topic]
        stop = min(start + min(size, short or size), n)
        return [(i, f"d{i:03d}") for i in range(start, stop)], n

    return fetch


def _ingest(spark, tmp_path, name, fetch, **more):
    spark.dataSource.register(pages.page_source(name, "i int, day string", fetch, delay=0.01))
    return pages.PagedIngest(spark, name, f"file://{tmp_path}/{name}", **more)


def test_pages_until_the_end(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    fetch = _service(str(calls), {"a": 23, "b": 4, "c": 0}, fails={("a", 5), ("b", 0)}, short=3)
    job = _ingest(spark, tmp_path, "ends", fetch, topics=["a", "b", "c"], size=5, ahead=2)
    status = job.run()
    assert {t: (s["reason"], s["fetched"]) for t, s in status.items()} == {"a": ("end", 23), "b": ("end", 4), "c": ("end", 0)}
    assert sorted((r.topic, r.i) for r in job.records().collect()) == [("a", i) for i in range(23)] + [("b", i) for i in range(4)]
    n = len(list(calls.iterdir()))
    # All topics have ended: nothing more is asked for.
    assert job.run() == status and len(list(calls.iterdir())) == n


def test_pages_stop_at_empty_ones_and_go_on_after_a_limit(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    job = _ingest(spark, tmp_path, "limits", _service(str(calls), {"a": 400}), topics=["a"], size=10, ahead=3, max_pages=4, max_empty=2, keep="record.day < 'd055'")
    assert job.run()["a"] == {"pages": 4, "fetched": 40, "kept": 40, "next": 40, "reason": "limit"}
    # Pages at 60 and 70 keep nothing; that of the round behind them is no result.
    assert job.run()["a"] == {"pages": 8, "fetched": 80, "kept": 55, "next": 80, "reason": "empty"}
    assert sorted(r.i for r in job.records().collect()) == list(range(55))
    starts = [int(p.name.split("-")[1]) for p in calls.iterdir()]
    assert len(starts) == len(set(starts))


def test_a_failed_round_is_read_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    inner = _service(str(calls), {"a": 12})
    gate = str(tmp_path / "open")

    def fetch(topic, start, size):
        import os

        if start == 8 and not os.path.exists(gate):
            raise OSError("down")
        return inner(topic, start, size)

    job = _ingest(spark, tmp_path, "fails", fetch, topics=["a"], size=4, ahead=1)
    with pytest.raises(Exception, match="down"):
        job.run()
    assert job.status()["a"]["next"] == 8
    open(gate, "w").close()
    assert job.run()["a"]["reason"] == "end" and sorted(r.i for r in job.records().collect()) == list(range(12))
