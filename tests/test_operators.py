import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborlake.functions import identity, text, validate
from arborlake.operators import context, corpus, evidence, graph, ranking, textgen, versions


def test_identity_forms(spark):
    rows = [
        ("2401.01234v2", "2401.01234", "2401.01234v2", 2),
        (" hep-th/9901001 ", "hep-th/9901001", "hep-th/9901001", None),
        ("https://arxiv.org/pdf/2401.01234v3.pdf?download=1#p2", "2401.01234", "2401.01234v3", 3),
        ("http://export.arxiv.org/abs/math.GT/0309136", "math.GT/0309136", "math.GT/0309136", None),
        ("https://example.org/abs/2401.01234", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "raw string, base string, vid string, v int")
    got = df.select("base", "vid", "v", identity.paper_identity(F.col("raw")).alias("i")).collect()
    for r in got:
        assert (r.i.base_id, r.i.version_id, r.i.version) == (r.base, r.vid, r.v)


def test_aliases_and_uuid(spark):
    r = spark.range(1).select(identity.lookup_aliases(identity.paper_identity(F.lit("2401.01234v2"))).alias("a"), identity.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.lit("x")).alias("u")).first()
    import uuid

    assert len(r.a) == 14 and len(set(r.a)) == 14
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))


def test_text_functions(spark):
    r = spark.range(1).select(
        text.tokens(F.lit("The GPT-4.5 model is a b and uses x_y++ data")).alias("t"),
        text.clip(F.lit("alpha beta, gamma delta"), 12).alias("c"),
        text.clean_page(F.lit("hy-\nphen\x00ated")).alias("p"),
        text.truncated_json(F.lit('{"a": 1')).alias("j"),
        text.clean_optional(F.array(F.lit("N/A."), F.lit(" x "), F.lit("x"), F.lit("none"))).alias("o"),
    ).first()
    assert r.t == ["gpt-4.5", "model", "uses", "x_y", "data"]
    assert r.c == "alpha beta…" and r.p == "hyphenated" and r.j is True and r.o == ["x"]


def test_retention_policy(spark):
    df = spark.createDataFrame([(1, ["cs.AI"], "2024-01-02"), (2, ["cs.AI2"], "2024-01-02"), (3, ["cs.AI"], None), (4, ["cs.AI", "cs.LG"], "2023-01-01")], "id int, c array<string>, d string")
    any_ = corpus.RetentionPolicy(["cs.AI", "cs.LG"], "any", start="2024-01-01")
    all_ = corpus.RetentionPolicy(["cs.AI", "cs.LG"], "all")
    assert [r.id for r in corpus.retain(df, any_, F.col("c"), F.col("d")).collect()] == [1]
    assert [r.id for r in corpus.retain(df, all_, F.col("c"), F.col("d")).collect()] == [4]
    with pytest.raises(ValueError):
        corpus.RetentionPolicy([])


def test_versioned_table_swaps_or_stays(spark, tmp_path):
    table = corpus.VersionedTable(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(i, ["a" if i % 4 == 0 else "b"], "2024") for i in range(40)], "id int, c array<string>, d string")
    report = corpus.replace_corpus(table, df, corpus.RetentionPolicy(["a"]), "c", "d", "id", "r1")
    assert report["retained"] == 10 and table.read().count() == 10
    with pytest.raises(ValueError):
        corpus.replace_corpus(table, df, corpus.RetentionPolicy(["zzz"]), "c", "d", "id", "r2")
    with pytest.raises(ValueError):
        table.write(df, "r3", lambda out: ["no"])
    assert table.current() == "r1"


def test_upsert(spark):
    schema = "k int, v int, t string"
    cur = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (3, 2, None), (9, 1, "z")], schema)
    new = spark.createDataFrame([(1, 2, "A"), (1, 3, "AA"), (2, 4, "B"), (3, 2, "C"), (4, None, "D")], schema)
    c, a = versions.upsert(cur, spark.createDataFrame([], schema), new, ["k"], "v", ["t"])
    assert {(r.k, r.v, r.t) for r in c.collect()} == {(1, 3, "AA"), (2, 5, "b"), (3, 2, "C"), (4, None, "D"), (9, 1, "z")}
    assert {(r.k, r.v) for r in a.collect()} == {(1, 1), (1, 2), (2, 4)}


def test_diversity_equals_greedy_loop(spark):
    rng = random.Random(3)
    for case in range(6):
        n, penalty = rng.randint(1, 25), rng.choice([0.05, 0.2, 0.5])
        scores = sorted((rng.randint(0, 8) / 8 for _ in range(n)), reverse=True)
        rows = [(i + 1, rng.choice("abc"), s) for i, s in enumerate(scores)]
        got = ranking.diversity(spark.createDataFrame(rows, "position int, g string, s double"), "g", "s", penalty).orderBy("new_rank").select("position").collect()
        lo, hi = min(scores), max(scores)
        norm = {p: (s - lo) / (hi - lo) if hi > lo else 1.0 for p, _, s in rows}
        left, used, want = list(rows), {}, []
        while left:
            best = max(left, key=lambda r: (round(norm[r[0]] - penalty * used.get(r[1], 0), 9), -r[0]))
            left.remove(best)
            used[best[1]] = used.get(best[1], 0) + 1
            want.append(best[0])
        assert [r.position for r in got] == want, case


def test_graph(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (10, 11)]
    p = spark.createDataFrame(edges, "u long, v long")
    assert {(r.node, r.component) for r in graph.components(p).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10)}
    assert {r.node: r.triangles for r in graph.triangles(p).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.node: r.hops for r in graph.shortest_paths(p, 1, 4).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    b = graph.betweenness([(1, 2), (2, 3)], False)
    assert b == {1: 0.0, 2: 1.0, 3: 0.0}


def test_sentences_and_spans():
    t = 'See Fig. 3 by Dr. A. Smith et al. for 3.5 points. "It works well here." Next one'
    assert [t[a:b] for a, b in evidence.sentences(t)] == ["See Fig. 3 by Dr. A. Smith et al. for 3.5 points.", '"It works well here."', "Next one"]
    page = "One first sentence has many words in it. The second sentence also has quite many words. A third sentence ends the page nicely here."
    span, cut = evidence.verification_span("second sentence also", page)
    assert span == page and not cut
    assert evidence.verification_span("absent words", page) == ("absent words", True)
    assert evidence.find_quote("One first sentence has many words in THAT The second sentence also", page).startswith("One first")
    assert evidence.find_quote("short", page) is None


def test_context_package_budget_and_closure():
    items = [{"statement": "s" * 50 * (i + 1), "evidence_ids": [f"e{i}"]} for i in range(5)]
    ev = {f"e{i}": "q" * 40 for i in range(5)} | {"h": "head"}
    head = {"statement": "t", "evidence_ids": ["h"]}
    last = -1
    for budget in (100, 150, 250, 400, 1000):
        p = context.package(head, items, ev, budget)
        assert p["estimated_tokens"] <= budget and context.estimate(p) == p["estimated_tokens"]
        assert len(p["items"]) >= last
        assert set(p["evidence"]) == {"h"}.union(*[i["evidence_ids"] for i in p["items"]]) if p["items"] else {"h"}
        last = len(p["items"])
    assert last == 5
    with pytest.raises(ValueError):
        context.package(head, items, ev, 3)
    with pytest.raises(ValueError):
        context.package(head, items, {"h": "x"}, 500)


def test_fit_response_keeps_one_paper():
    r = {"papers": [{"id": i, "abstract": "a" * 2000, "items": [1, 2, 3]} for i in range(4)]}
    out = context.fit_response(r, 15)
    assert len(out["papers"]) == 1 and out["budget"]["truncated"] and out["budget"]["omitted_papers"] == 3 and out["estimated_tokens"] == context.estimate(out)


def test_fit_response_order_of_cuts():
    long = "word " * 400
    papers = [{"id": 0, "tier": 1, "abstract": long, "items": ["a" * 60, "b" * 60, "c" * 60]}, {"id": 1, "tier": 0, "abstract": long, "items": []}]
    at = lambda tokens: context.fit_response({"papers": papers}, tokens)
    whole = at(10**6)
    assert [p["abstract"] for p in whole["papers"]] == [long, long] and not whole["budget"]["truncated"] and whole["coverage"]["evidence_backed_papers"] == 1
    # Just below each document's size, the next cut is made.
    steps = [at(whole["estimated_tokens"] - 40)]
    while len(steps[-1]["papers"]) == 2 and len(steps) < 9:
        steps.append(at(steps[-1]["estimated_tokens"] - 1))
    seen = [(p[0]["abstract"] is None, len(p[0]["items"]), len(p[1]["abstract"] or "") <= 800) for s in steps if len(p := s["papers"]) == 2]
    assert list(dict.fromkeys(seen)) == [(True, 3, False), (True, 2, False), (True, 1, False), (True, 1, True)]
    assert steps[-1]["budget"]["omitted_papers"] == 1


def test_text_scores():
    a = "the cat sat on the mat".split()
    assert textgen.bleu([a], a) == pytest.approx(1.0) and textgen.rouge_l(a, a) == 1.0
    assert textgen.rouge1(a, "the dog".split()) == pytest.approx(2 * 1 / 8)
    assert textgen.bleu([a], []) == 0.0 and textgen.meteor(a, ["zzz"]) == 0.0


def test_record_validation(spark):
    base = {"feedback_id": "f", "occurred_at": "2024-01-01 00:00:00", "source": "human", "workflow": None, "run_id": None, "stage": "s", "reason": "adopted", "kind": "idea", "paper_id": "p", "verdict": None, "note": None, "follow_up_of": None, "request_id": None, "idea_ref": "i", "topic": "t"}
    cases = [({}, None), ({"feedback_id": " "}, "feedback_id"), ({"occurred_at": "soon"}, "occurred_at"), ({"source": "agent"}, "agent origin"), ({"kind": "paper"}, "reason and subject"), ({"reason": "Bad-One"}, "reason"), ({"reason": "trial_failed"}, "outcome needs follow_up_of"), ({"verdict": "MAYBE"}, "verdict"), ({"reason": "new_reason", "kind": "topic"}, None), ({"idea_ref": " "}, "subject idea"), ({"reason": "coverage_gap", "kind": "topic"}, "coverage_gap needs queries")]
    schema = ", ".join(f"{k} string" for k in base)
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)
    df = df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in validate.OPTIONAL.items() if name not in base])
    assert [r.e for r in df.select(validate.first_record_error().alias("e")).collect()] == [e for _, e in cases]


def test_streaming_dedupe_and_resume(spark, tmp_path):
    from arborlake.streaming import series

    schema = "event_id long, ts timestamp"
    src, sink, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    rows = [(i % 5, datetime(2024, 1, 1, 0, i)) for i in range(10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    run = lambda: series.resumable(spark, src, schema, sink, check, lambda s: series.replay_dedupe(s, ["event_id"], "ts", "1 hour"))
    run()
    assert spark.read.parquet(sink).count() == 5
    spark.createDataFrame([(3, datetime(2024, 1, 1, 0, 11)), (77, datetime(2024, 1, 1, 0, 12))], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4, 77]


def test_late_versions(spark, tmp_path):
    from arborlake.streaming import series

    table, archive = corpus.VersionedTable(spark, f"file://{tmp_path}/t"), corpus.VersionedTable(spark, f"file://{tmp_path}/a")
    schema = "k int, v int, t string"
    for i, rows in enumerate([[(1, 2, "b")], [(1, 1, "a"), (2, None, "x")], [(2, 1, "y")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        series.merge_versions(spark, f"{tmp_path}/in", schema, table, archive, ["k"], "v", ["t"], f"{tmp_path}/ck")
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, 2), (2, 1)}
    assert {(r.k, r.v) for r in archive.read().collect()} == {(1, 1), (2, None)}


def test_feed_and_articles(spark):
    from arborlake.sources import readers

    xml = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:a="urn:a"><entry><id>u1</id><title> A
 title</title><summary>S</summary><published>2024</published><updated>2025</updated><author><name>X Y</name></author><a:primary_category term="c2"/><category term="c1"/><category term="c2"/></entry></feed>"""
    r = readers.parse_feed(spark.createDataFrame([(xml,), ("<feed/>",)], "xml string")).collect()
    assert len(r) == 1 and r[0].title == "A title" and r[0].categories == ["c2", "c1"] and r[0].authors == ["X Y"]
    art = "<S><PubmedArticle><M><PMID>7</PMID><ArticleTitle>T</ArticleTitle><AbstractText>Ab</AbstractText><Journal><Title>J</Title></Journal><AuthorList><Author><LastName>L</LastName></Author><Author/></AuthorList></M></PubmedArticle></S>"
    (p,) = readers.parse_articles(spark.createDataFrame([(art,)], "xml string")).collect()
    assert (p.pmid, p.title, p.journal, p.authors) == ("7", "T", "J", ["L"])


def test_betweenness_of_all_equals_the_plain_one(spark):
    r = random.Random(3)
    edges = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(55)}) + [(100, 101), (101, 102)]
    got = {x.node: x.betweenness for x in graph.betweenness_of_all(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = graph.betweenness(edges)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_betweenness_of_all_writes_no_pairs_of_ends(spark, monkeypatch):
    edges = [(0, k) for k in range(1, 300)] + [(1, 500), (500, 501), (0, 501), (700, 701), (800, 800), (501, 501)]
    written, cut = [], graph._cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "_cut", counted)
    got = {x.node: x.betweenness for x in graph.betweenness_of_all(spark.createDataFrame(edges, "u long, v long"), False).collect()}
    want = graph.betweenness([e for e in edges if e[0] != e[1]], False)
    assert got.pop(800) == 0 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert max(written) < 3 * len(edges)


def test_graph_queries_without_sql_read_all_orders(spark, tmp_path):
    from arborlake.plans import registry

    orders = [(k, 1 + k % 45) for k in range(1, 91)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    nodes = {c for _, c in orders} | {-o for o, _ in orders}
    want = graph.betweenness([(c, -o) for o, c in orders])
    got = {x.node: x.betweenness for x in registry.QUERIES["betweenness"](spark, str(tmp_path)).collect()}
    assert set(got) == nodes and all(abs(got[k] - want[k]) < 1e-9 for k in nodes)
    assert {x.node for x in registry.QUERIES["label_propagation"](spark, str(tmp_path)).collect()} == nodes


def test_targets_of_points_equal_those_of_papers_and_group_once(spark):
    from pyspark.sql import functions as F

    from arborlake.operators.feedback import targets, targets_of_points

    rows = [(1, 2, "b", "t", "p9"), (1, 1, "a", "t", "p1"), (1, 1, "a", "t", "p2"), (1, 2, "b", "t", "p1"), (1, 2, "b", "t", "p9"), (2, 1, None, None, "p1"), (2, 1, None, None, "p1"), (3, 5, "z", "t", "q")]
    points = spark.createDataFrame(rows, "request long, rank int, paper_id string, tier string, point_id string").repartition(3)
    papers = points.groupBy("request", "rank", "paper_id", "tier").agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))
    out = targets_of_points(points, "request")
    got, want = (sorted((r.request, r.paper_ids, r.point_ids, [tuple(p) for p in r.papers]) for r in d.collect()) for d in (out, targets(papers, "request")))
    assert got == want and got[0][1:3] == (["a", "b"], ["p1", "p2", "p9"])
    plan = targets_of_points(spark.range(9).selectExpr("id % 3 request", "1 rank", "'a' paper_id", "'t' tier", "'p' point_id"), "request")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
