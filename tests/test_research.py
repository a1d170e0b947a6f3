import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import text, validate
from arborlake.operators import analyses, context, corpus, curated, feedback, graph, maintenance, models, suites, topics
from arborlake.service import ResearchService

ANALYSIS = """paper_id string, analysis_id string, document_hash string, title string, generated_at long, is_current boolean, tldr struct<statement:string,evidence_ids:array<string>>,
 claims array<struct<field:string,statement:string,evidence_ids:array<string>>>, ideas array<struct<title:string,description:string,agent_use:string,expected_benefit:string,risks:array<string>,evidence_ids:array<string>>>,
 concepts array<string>, tags array<string>, evidence array<struct<evidence_id:string,page:int,quote:string,section:string,truncated:boolean>>"""
PAGE = "We built a large system for parsing old books. It reads every page twice and compares the results. Errors fall by half in our tests."


def rows():
    quote = "It reads every page twice"
    good = ("p1", "a1", "h1", "T", 5, True, ("short", ["e1"]), [("methods", "m", ["e1", "e2"]), ("results", "r", ["e2"])], [(" i ", " ", "use it", "", ["None.", "cost", "cost"], ["e1", "e1"])], ["c"], [], [("e1", 1, quote, None, False), ("e2", 1, "cut off", "intro", True)])
    older = (*good[:1], "a0", *good[2:4], 1, *good[5:])
    bad = ("p2", "b1", "h2", "U", 2, True, ("s", ["e3"]), [("results", "r", ["e9"])], [], [], [], [("e3", 2, "gone", None, True)])
    return [good, older, bad]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), ANALYSIS)


def test_trusted_analyses(table):
    got = {r.analysis_id: r for r in analyses.trusted(table).collect()}
    a = got["a1"]
    assert a.error is None and [e.evidence_id for e in a.evidence] == ["e1"] and [(c.statement, c.evidence_ids) for c in a.claims] == [("m", ["e1"])]
    assert got["b1"].error == "unknown evidence: e9"


def test_index_points(spark, table):
    points = analyses.index_points(table.where("analysis_id = 'a1'"), "model")
    got = {(r.kind, r.category): r for r in points.collect()}
    assert set(got) == {("evidence", "source_evidence"), ("claim", "tldr"), ("claim", "methods"), ("implementation_idea", "implementation_idea")}
    idea = got["implementation_idea", "implementation_idea"]
    assert idea.text == "use it" and idea.evidence_ids == ["e1"] and idea.embedding_text.endswith("Source evidence:\nPage 1: It reads every page twice")
    import uuid

    assert idea.point_id == str(uuid.uuid5(uuid.UUID(hex=analyses.NAMESPACE), idea.identity))
    first, report = analyses.upsert_points(points.limit(0), points)
    assert first.count() == 4 and [r.status for r in report.collect()] == ["indexed"]
    again, report = analyses.upsert_points(points, points)
    assert again.count() == 4 and [r.status for r in report.collect()] == ["unchanged"]
    other = analyses.index_points(table.where("analysis_id = 'a1'"), "model", "2")
    moved, _ = analyses.upsert_points(points, other)
    assert {r.analysis_key for r in moved.collect()} == {r.analysis_key for r in other.collect()} and moved.count() == 4


def test_an_upsert_by_papers_against_the_definition(spark):
    r = random.Random(8)
    key, point = (lambda p: r.choice([None, *[f"k{p}-{i}" for i in range(3)]])), (lambda p: r.choice([None, *[f"i{p}-{i}" for i in range(5)]]))
    some = lambda papers, n: [(p, key(p), point(p), i) for i in range(n) for p in [r.choice(papers)]]
    old, new = some([None, 1, 2, 3, 4], 60), some([None, 3, 4, 5, 6], 40) + [(7, "k7", "i7-1", 0), (7, "k7", "i7-2", 1)]
    old += [(7, "k7", "i7-1", 5), (7, "k7", "i7-3", 6), (7, "k8", "i7-4", 7)]
    n = lambda rows, k: sum(x[1] == k for x in rows)
    status = {(p, k): "unchanged" if k is not None and n(old, k) == n([x for x in new if x[0] == p], k) else "indexed" for p, k, *_ in new}
    fresh = [x for x in new if x[1] is not None and status[x[:2]] == "indexed"]
    stale = {x[2] for x in old for (p, k), s in status.items() if s == "indexed" and None not in (p, k, x[1]) and x[0] == p and x[1] != k}
    gone = (stale | {x[2] for x in fresh}) - {None}
    want = [x for x in old if x[2] not in gone] + fresh
    kind = "paper_id long, analysis_key string, point_id string, n long"
    table, report = analyses.upsert_points(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))
    assert sorted(map(repr, map(tuple, table.collect()))) == sorted(map(repr, want))
    rows = [tuple(x) for x in report.collect()]
    assert len(rows) == len(status) and {x[:2]: x[2] for x in rows} == status
    assert {x[:2]: x[3] for x in rows} == {(p, k): sum(x[:2] == (p, k) for x in new) for p, k in status}


def test_an_upsert_sends_lines_once_and_writes_no_points(spark, monkeypatch):
    from arborlake.plans import q_research, registry

    written, kept = [], q_research.cut
    monkeypatch.setattr(q_research, "LINES_A_TASK", 2000, raising=False)
    monkeypatch.setattr(q_research, "cut", lambda df: written.append(df) or kept(df))
    registry.QUERIES["index_upsert"](spark, "/root/testdata/sf0.001").collect()
    assert written and not any("point_id" in x.schema.simpleString() for x in written)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o#" in plan and "hashpartitioning(paper_id#" not in plan


def test_repair(spark, table):
    pages = spark.createDataFrame([("h1", 1, PAGE)], "document_hash string, page int, text string")
    each, totals = analyses.repair(table, pages)
    got = {r.analysis_id: r for r in each.collect()}
    assert got["b1"].error == "document hash mismatch" and got["b1"].evidence[0].quote == "gone"
    e = {x.evidence_id: x for x in got["a1"].evidence}
    assert "It reads every page twice and compares the results." in e["e1"].quote and not e["e1"].truncated and e["e2"].truncated
    assert got["a1"].ideas[0].title == "i" and got["a1"].ideas[0].risks == ["cost"]
    assert totals.first().asDict() == {"evidence_total": 4, "evidence_expanded": 2, "evidence_truncated": 2, "ideas_total": 2, "ideas_changed": 2}


def test_packages_grow_with_their_budget():
    head = {"statement": "s", "evidence_ids": ["e0"]}
    items = [{"field": "methods", "statement": f"claim {i} " * 20, "evidence_ids": [f"e{i % 7}"]} for i in range(60)]
    evidence = {f"e{i}": "quote " * 30 for i in range(7)}
    checks = context.package_checks(head, items, evidence)
    assert [c["profile"] for c in checks] == ["brief", "standard", "deep"] and all(c["budget_compliant"] and c["evidence_closed"] and c["deterministic"] and c["monotonic"] for c in checks)
    assert checks[0]["units"] < checks[1]["units"]
    with pytest.raises(ValueError, match="least"):
        context.package(head, items, evidence, 3)


def hits(spark, ids, evidence):
    if evidence:
        return spark.createDataFrame([(i, f"pt{i}", "evidence", [f"e{i}"], 0.9 - i / 100, n + 1) for n, i in enumerate(ids)], "paper_id long, point string, kind string, evidence_ids array<string>, relevance double, rank int")
    return spark.createDataFrame([(i, 0.8 - i / 100, n + 1) for n, i in enumerate(ids)], "paper_id long, relevance double, rank int")


def test_curated_search_fails_over_and_filters(spark):
    meta = spark.createDataFrame([(i, f"202{i % 5}-01-01", ["x"] if i % 2 else ["y"], 2020 + i % 5, f"T{i}") for i in range(12)], "paper_id long, d string, categories array<string>, update_year int, title string").select("*", F.col("d").cast("timestamp").alias("published"))

    def broken(n):
        df = hits(spark, [1], False)
        return df.where(F.raise_error(F.lit("index is down")).isNotNull())

    cover = {}
    both = curated.curated_search(lambda n: hits(spark, [1, 2, 3], True), lambda n: hits(spark, [3, 4, 5], False), meta, "paper_id", 4, "2024-06-01", report=cover)
    assert both.count() == 4 and cover["evidence_backed_papers"] == 3 and not cover["partial"] and cover["unique_candidate_papers"] == 5
    one = curated.curated_search(lambda n: hits(spark, [1, 2, 3], True), broken, meta, "paper_id", 4, "2024-06-01", report=cover)
    assert {r.paper_id for r in one.collect()} == {1, 2, 3} and cover["partial"] and "index is down" in cover["sources"][1]["error"]
    other = curated.curated_search(broken, lambda n: hits(spark, [3, 4], False), meta, "paper_id", 4, "2024-06-01", report=cover)
    assert {(r.paper_id, r.tier) for r in other.collect()} == {(3, 0), (4, 0)} and all(r.items == [] for r in other.collect())
    with pytest.raises(curated.SearchUnavailable):
        curated.curated_search(broken, broken, meta, "paper_id", 4, "2024-06-01")
    some = curated.curated_search(lambda n: hits(spark, [1, 2, 3], True), lambda n: hits(spark, [4, 5], False), meta, "paper_id", 9, "2024-06-01", categories=["x"], start_year=2021, end_year=2023, report=cover)
    assert {r.paper_id for r in some.collect()} == {1, 3}
    none = curated.curated_search(lambda n: hits(spark, [1], True), lambda n: hits(spark, [2], False), meta, "paper_id", 9, "2024-06-01", min_relevance=0.95, report=cover)
    assert none.count() == 0 and cover["result_status"] == "no_match" and cover["no_match_reason"]
    answer = curated.respond(both, "paper_id", 10_000, cover)
    assert len(answer["papers"]) == 4 and answer["papers"][0]["title"] and answer["budget"]["omitted_papers"] == 0


def test_trace(spark, tmp_path):
    trace = curated.Trace(spark, f"file://{tmp_path}")
    trace.start("rs_1", "q", "2024-01-01")
    trace.start("rs_2", "q2", "2024-01-01")
    trace.pulls("rs_1", [{"source": "evidence", "status": "matches", "returned_candidates": 3}])
    trace.complete("rs_1", spark.range(3), "2024-01-02")
    trace.fail("rs_2", "down", "2024-01-02")
    assert {(r.request_id, r.status, r.query) for r in trace.runs().collect()} == {("rs_1", "complete", "q"), ("rs_2", "failed", "q2")}


def test_candidate_limit():
    assert [curated.candidate_limit(n) for n in (1, 20, 500)] == [50, 80, 200]


def test_feedback_in_the_order_of_the_batch(spark):
    cols = "n int, feedback_id string, paper_id string, point_id string, request_id string, kind string, reason string"
    data = [
        (1, "f1", "p9", None, "r1", "paper", "off_topic"), (2, "f1", "p1", None, "r1", "paper", "off_topic"), (3, "f1", "p9", None, "r1", "paper", "off_topic"), (4, "f2", "p1", "x", "r1", "idea", "adopted"),
        (5, "f3", "p1", "pt", "r1", "idea", "adopted"), (6, "f4", "p1", None, "r2", "paper", "off_topic"), (7, "f5", "p9", None, "r1", "paper", "off_topic"), (8, "f6", "p1", None, None, "idea", "off_topic"), (9, "f3", "p1", "pt", "r1", "idea", "adopted"),
    ]
    df = spark.createDataFrame(data, cols)
    for name, value in {"occurred_at": "2024-01-01", "source": "human", "workflow": None, "run_id": None, "stage": "s", "verdict": None, "note": None, "follow_up_of": None, "idea_ref": "i"}.items():
        df = df.withColumn(name, F.lit(value).cast("string"))
    outputs = spark.createDataFrame([("r1", "p1", ["pt"])], "request_id string, paper_id string, point_ids array<string>")
    stored = spark.createDataFrame([("f5",)], "feedback_id string")
    got = {r.n: (r.status, r.error) for r in feedback.acknowledge(df, stored, outputs, "n").collect()}
    assert got == {
        1: ("rejected", "paper was not delivered"), 2: ("accepted", None), 3: ("duplicate", None), 4: ("rejected", "point was not delivered"), 5: ("accepted", None), 6: ("rejected", "request has no archived output"),
        7: ("duplicate", None), 8: ("rejected", "reason and subject"), 9: ("duplicate", None),
    }


def test_envelopes_and_nested_parts(spark):
    kind = "contract string, contract_version string, taxonomy_version string, client struct<name:string,version:string>, project struct<id:string>, records array<int>"
    good = (validate.CONTRACT, validate.CONTRACT_VERSION, "1", ("n", "1"), ("p",), [1])
    cases = [good, ("x", *good[1:]), (*good[:3], None, *good[4:]), (*good[:5], []), (*good[:5], list(range(101)))]
    errors = [r.e for r in spark.createDataFrame(cases, kind).select(validate.envelope_error().alias("e")).collect()]
    assert errors[0] is None and "contract must" in errors[1] and "client" in errors[2] and "at least one" in errors[3] and "no more than 100" in errors[4]
    df = spark.createDataFrame([(("q", 0.5, 1), ["a"], (1, 0)), (("q", 1.5, 1), ["a", " "], (-1, 0)), (("q", 0.5, 0), [], (1, None)), (None, None, None)], "r struct<query:string,relevance:double,rank:int>, q array<string>, c struct<papers:long,points:long>")
    got = [tuple(r) for r in df.select(validate.retrieval_error(F.col("r")), validate.queries_error(F.col("q")), validate.corpus_error(F.col("c"))).collect()]
    assert got == [(None, None, None), ("retrieval.relevance", "queries", "corpus.papers"), ("retrieval.rank", None, "corpus.points"), (None, None, None)]


def test_recursive_split():
    r = random.Random(1)
    t = "\n\n".join(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 80))) for _ in range(30)) + "\n\n" + "z" * 2500
    pieces = text.split_text(t, 300, 60)
    assert max(map(len, pieces)) <= 300 and "".join(pieces).count("z") >= 2500 and all(p in t for p in pieces)
    words = [w for p in pieces for w in p.split()]
    assert set(t.split()) - {"z" * 2500} <= set(words) and text.split_text("short") == ["short"] and text.split_text("") == []


def test_reference_sections(spark):
    pages = [("d", 1, "intro\nReferences\n[1] a"), ("d", 2, "[2] b"), ("d", 3, "A\nEXTRA PROOFS\nx\nreferences\nlist"), ("d", 4, "tail"), ("d", 5, "References"), ("d", 6, "Appendix B\ny"), ("e", 1, "no list"), ("e", 2, None)]
    out = text.strip_references(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page", "text")
    got = {(r.doc, r.page): r.text for r in out.collect()}
    # Page 3 ends the list and stays whole, so its own heading does not count.
    assert got == {("d", 1): "intro", ("d", 2): "", ("d", 3): pages[2][2], ("d", 4): "tail", ("d", 5): "", ("d", 6): "Appendix B\ny", ("e", 1): "no list", ("e", 2): None}


def test_models_are_functions(spark):
    df = spark.createDataFrame([(i, f"paper about topic {i % 3} and method {i}") for i in range(20)], "id long, text string")
    vectors = {r.id: r.embedding for r in models.embed(df, "id", "text", prefix="q: ").collect()}
    want = models.hashed_embedding([f"q: paper about topic {i % 3} and method {i}" for i in range(20)])
    assert np.allclose([vectors[i] for i in range(20)], want, atol=1e-6) and all(len(v) == 64 for v in vectors.values())
    with pytest.raises(Exception, match="vectors for"):
        models.embed(df, "id", "text", lambda texts: [[1.0]]).collect()
    with pytest.raises(Exception, match="empty"):
        models.embed(df, "id", "text", lambda texts: [[] for _ in texts]).collect()
    asked = []

    def call(prompt, tokens):
        asked.append(tokens)
        return ('{"a": 1}', False) if len(asked) == 2 else ('{"a":', True)

    assert models.structured(call, json.loads, "p", 100) == {"a": 1} and asked == [100, 200]
    with pytest.raises(models.ModelError):
        models.structured(lambda p, n: ("no", False), json.loads, "p")

    def answer(prompt):
        if "3" in prompt:
            raise ValueError("no")
        return prompt.upper()

    out = models.prompt_map(df.where("id < 4"), "id", ["text"], {"t": lambda r: f"say {r['id']}", "u": lambda r: "x"}, answer).collect()
    assert len(out) == 8 and {(r.id, r.task) for r in out if r.error} == {(3, "t")} and all(r.answer == "X" for r in out if r.task == "u")


def test_workflows():
    def index(x):
        if x == "p2":
            raise RuntimeError("no pdf")
        return x + "!"

    steps = [("fetch", lambda x: x), ("index", index)]
    assert models.workflow("p1", steps) == {"status": "complete", "done": ["fetch", "index"], "result": "p1!"}
    assert models.batch_workflow(["p1", "p2", "p3"], steps) == {"processed": 3, "complete": 2, "failures": [{"paper": "p2", "step": "index", "error": "RuntimeError: no pdf"}]}
    assert models.batch_workflow(["p2", "p3"], steps, stop_after=1)["processed"] == 1


def test_indexing_resumes_and_stops_at_batches(spark, tmp_path):
    source = spark.range(95).select(F.col("id").alias("k"))
    stored = []

    def index(batch):
        got = [r.k for r in batch.collect()]
        stored.extend(got)
        return len(got)

    ticks = iter(range(0, 10_000, 40))
    make = lambda: maintenance.IndexRun(spark, source, "k", index, lambda: len(stored), f"file://{tmp_path}/state.json", 20, lambda: next(ticks))
    assert make().run(this_run=30)["status"] == "partial" and stored == list(range(30))
    # A minute has passed after the second batch.
    state = make().run(minutes=1)
    assert state["processed"] == 70 and state["status"] == "partial"
    assert make().run(most=75)["processed"] == 75
    assert make().run() == {"processed": 95, "last": 94, "status": "complete"} and stored == list(range(95))
    stored.pop()
    with pytest.raises(maintenance.IndexMismatch):
        make().run()
    with pytest.raises(ValueError):
        make().run(this_run=1, minutes=1)


def test_maintenance(spark, tmp_path):
    root = f"file://{tmp_path}"
    maintenance.write_report(spark, {"b": 1, "a": [1, "é"]}, f"{root}/r.json")
    assert json.loads(maintenance.read_text(spark, f"{root}/r.json")) == {"a": [1, "é"], "b": 1} and maintenance.read_text(spark, f"{root}/none") is None
    path = maintenance.copy_snapshot(spark.range(5), root, "papers", "20240101")
    with pytest.raises(Exception, match="exists"):
        maintenance.copy_snapshot(spark.range(5), root, "papers", "20240101")
    assert maintenance.clear(spark, {"papers": path}) == {"papers": 5} and spark.read.parquet(path).count() == 5
    assert maintenance.clear(spark, {"papers": path}, confirm=True) == {"papers": 5}
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_two_writers_of_a_versioned_table(spark, tmp_path, monkeypatch):
    a, b = (corpus.VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.write(spark.range(1), "one")
    # Both saw version one as the newest.
    monkeypatch.setattr(a, "_newest", lambda: 1)
    monkeypatch.setattr(b, "_newest", lambda: 1)
    a.write(spark.range(2), "two")
    with pytest.raises(RuntimeError, match="another writer"):
        b.write(spark.range(3), "three")
    assert corpus.VersionedTable(spark, f"file://{tmp_path}/t").read().count() == 2


def test_time_boxed_stream(spark, tmp_path):
    from arborlake.streaming import series

    for i in range(6):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}")
    series.time_boxed(read(), sink, f"{tmp_path}/ck", 0)
    first = spark.read.parquet(f"{tmp_path}/out").count()
    assert first >= 10
    series.time_boxed(read(), sink, f"{tmp_path}/ck", 600)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(60))


def test_adhoc_queries(spark):
    edges = spark.createDataFrame([("a" * 30, "b"), ("b", "c")], "source string, target string")
    out = graph.adhoc(spark, {"e": edges}, "select source, target from {e}")
    assert {n["label"] for n in out["nodes"]} == {"a" * 19 + "…", "b", "c"} and len(out["edges"]) == 2
    for bad in ("drop table x", "select 1; select 2"):
        with pytest.raises(ValueError):
            graph.adhoc(spark, {"e": edges}, bad)


def test_topics(spark):
    r = random.Random(4)
    words = [["star", "planet", "orbit", "moon"], ["gene", "cell", "protein", "tissue"], ["court", "law", "judge", "appeal"]]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words[i % 3]) for _ in range(30))) for i in range(60)] + [(99, "")], "id long, text string")
    model = topics.fit(docs.where("id < 60"), "id", "text", 3)
    got = {x.id: (x.topic, x.probability) for x in topics.classify(docs, "id", "text", model).collect()}
    assert len({(i % 3, got[i][0]) for i in range(60)}) == 3 and got[99] == (-1, 0.0) and min(got[i][1] for i in range(60)) > 0.8
    assert {w for t in range(3) for w in model.words[t]} == {w for ws in words for w in ws}
    out = topics.classify_and_report(docs, "id", "text", 3).collect()
    assert sum(x.n for x in out) == 60 and all(x.name.startswith(f"{x.topic}_") for x in out)
    points = np.eye(40) + 0.01 * np.arange(40)[:, None]
    small = topics.hierarchy(points, 60)
    assert len(set(small)) == 5 and len(small) == 40 and len(set(topics.hierarchy(points, 3000))) == 30


def test_bags_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "The star and a Planet, star"), (2, ""), (3, None)], "id long, text string")
    bags = topics._bags(docs, "id", "text")
    assert "Exchange" not in bags._jdf.queryExecution().executedPlan().toString()
    assert {r.id: sorted(r.bag) for r in bags.collect()} == {1: ["planet", "star", "star"], 2: [], 3: []}


def test_benchmark_of_models(spark):
    judged = spark.createDataFrame([(1, 10), (2, 20)], "c int, item int")
    found = spark.createDataFrame([(1, 10, 1), (2, 5, 1)], "c int, item int, rank int")

    def failing():
        raise RuntimeError("no memory")

    out = suites.embedding_benchmark({"good": lambda: found, "absent": None, "bad": failing}, judged, "c", "item")
    assert [(o["model"], o["status"]) for o in out] == [("good", "complete"), ("absent", "unavailable"), ("bad", "failed")] and out[0]["mrr"] == 0.5 and "no memory" in out[2]["error"]


def test_service(spark, table):
    papers = spark.createDataFrame([("p1", "2024-01-01"), ("p3", "2024-01-01")], "paper_id string, d string").select("paper_id", F.col("d").cast("timestamp").alias("published"))
    s = ResearchService(papers, table, lambda n: hits(spark, [], True).withColumn("paper_id", F.col("paper_id").cast("string")), lambda n: hits(spark, [], False).withColumn("paper_id", F.col("paper_id").cast("string")))
    assert s.capabilities()["read_only"] and [r.paper_id for r in s.catalog().collect()] == ["p1", "p2"]
    assert json.loads(s.analysis("p1").first().document)["analysis_id"] == "a1" and s.analysis("p9").count() == 0
    c = {r.paper_id: (r.known, r.analysis is not None) for r in s.agent_context(spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paper_id string")).collect()}
    assert c == {"p1": (True, True), "p2": (False, True), "p3": (True, False)}
    p = s.context_package("p1", "brief")
    assert p["head"]["evidence_ids"] == ["e1"] and p["omitted"] == 0 and set(p["evidence"]) == {"e1"}
    with pytest.raises(ValueError, match="unknown evidence"):
        s.context_package("p2")
    with pytest.raises(LookupError):
        s.context_package("p9")
    assert [r.paper_id for r in s.evidence(spark.createDataFrame([("e1",), ("zz",)], "evidence_id string")).collect()] == ["p1"]
    assert s.search(5, "2024-06-01")["result_status"] == "no_match"
    status = analyses.collection_status({"evidence": spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>"), "discovery": None})
    assert status["status"] == "degraded" and status["collections"][0] == {"role": "evidence", "available": True, "points": 1, "dimensions": 2}


def test_names_from_a_setting():
    from arborlake.sources.readers import names_from

    assert names_from(" cs.AI, cs.LG\ncs.AI ") == ["cs.AI", "cs.LG"]
    with pytest.raises(ValueError):
        names_from(" , ")


def test_token_digest(spark):
    import hashlib

    got = text.token_hash(spark.createDataFrame([("a",), (None,)], "t string"), "t").collect()
    assert got[0]["index"] == int.from_bytes(hashlib.blake2s(b"a", digest_size=4, person=b"arxivlex").digest(), "big") and got[1]["index"] is None
