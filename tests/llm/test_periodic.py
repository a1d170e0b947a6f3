import random

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlake.llm import periodic_runs as pr

rng = random.Random(7)
NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def texts():
    words = [f"w{i}" for i in range(40)]
    out = [None, "", " \n ", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "é é é é é é é z", "a " * 3000]
    out += [" ".join(["a b a b a b a c"] * 9), "\t".join("abcabcabcabcd" * 4), " ".join("aabaabaabaabaab" * 3)]
    for _ in range(150):
        w = [rng.choice(words[: rng.choice([2, 3, 40])]) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(0, 3)):
            at, q = rng.randrange(len(w)), rng.randrange(1, 9)
            w[at:at] = (w[at : at + q] or ["z"]) * rng.randrange(2, 8)
        out.append(" ".join(w))
    return out + [" ".join(rng.choice(words) for _ in range(3000))]


def test_runs_against_growing_stretches(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("start", "n_runs", "runs", "period")}).repartition(3)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in pr.periodic_runs(df, reread=pr.looped, texts=False).collect()}
    want = brute.periodic(rows)
    assert got == want and sum(v[0] for v in want.values()) > 100
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_texts_and_rows_without_ids(spark):
    rows = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (None, "a a a a a a"), (None, None)]
    got = pr.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((str(r.doc_id), r.collapsed_text, [tuple(x) for x in r.runs]) for r in got) == [
        ("1", "a b c", [(0, 8, 2)]), ("1", "a b c", [(0, 8, 2)]), ("None", "", []), ("None", "a", [(0, 6, 1)]),
    ]


def _thue_morse(n):
    return [i.bit_count() & 1 for i in range(n)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5), st.sampled_from([16, 1 << 20]))
def test_runs_of_chunks(seqs, many):
    word = np.array([x for s in seqs for x in s], np.int64)
    ends = np.cumsum([len(s) for s in seqs])
    keep = pr.SLICE
    pr.SLICE = many
    try:
        got = [x.tolist() for x in pr.runs(word, ends)]
    finally:
        pr.SLICE = keep
    plain = [pr._plain_runs(word, int(e) - len(s), int(e)) for s, e in zip(seqs, ends, strict=True)]
    assert got == [np.concatenate(x).tolist() for x in zip(*plain, strict=True)]


def test_lying_hashes_are_found_out(monkeypatch):
    # Every stretch hashes alike: all that is found is verified, and the text is searched without hashes.
    word = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 2, 2, 2, 2, 2, 3] + _thue_morse(300) + [5] * 9)
    want = [x.tolist() for x in pr._plain_runs(word, 0, len(word))]
    monkeypatch.setattr(pr.Prefixes, "_stretch", lambda self, a, n: np.zeros(len(a), np.uint64))
    assert [x.tolist() for x in pr.runs(word, np.array([len(word)]))] == want and len(want[0]) >= 3


def test_prefixes_are_modular():
    word = np.array([rng.randrange(1 << 40) for _ in range(50)])
    pre, p = pr.Prefixes(word, 987654321987), (1 << 61) - 1
    total = 0
    for i, x in enumerate(word.tolist()):
        total = (total + (x + 1) * pow(987654321987, i, p)) % p
        assert int(pre.sum[i + 1]) == total
