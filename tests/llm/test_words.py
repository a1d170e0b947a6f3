"""Words that simple hashes confuse, and words that are made to share a hash."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.llm import _bytes, _verify, jaccard_join, packing, substring_dedup

rng = random.Random(3)
VOCAB = [f"w{i}" for i in range(300)]


def twins(n):
    """A Thue-Morse word and its complement, which have one hash modulo 2^64 under any odd base."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    h, s, e, t = _bytes.words(data, np.array([0, len(data)]))
    return data, s, e, h


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_twins_differ(n):
    a, b = twins(n)
    for lane in (0, 1):
        data, s, e, _ = spans(f"{a} {b} {a}")
        h = _bytes.span_hashes(data, s, e, lane)
        assert h[0] == h[2] != h[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=20), min_size=1, max_size=40), st.integers(0, 3))
def test_distinct_words_by_bytes(words, bits):
    data, s, e, h = spans(" ".join(words))
    first, back, single = _bytes.distinct(data, s, e, h & np.uint64((1 << bits) - 1))
    named = [words[i] for i in first.tolist()]
    assert len(set(named)) == len(named) and [named[i] for i in back.tolist()] == words and single <= 1 << bits


def test_tokenizer_of_twins(monkeypatch):
    tok = packing.WordTokenizer(packing.default_vocabulary())
    texts = [" ".join(twins(n)) for n in (1024, 2048)] + ["some plain words, and some more. words"]
    want = [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tok.encode(t).tolist() for t in texts + texts] == want + want
    # All words under one hash: the memo knows one of them, and the others are encoded each time.
    poor = packing.WordTokenizer(packing.default_vocabulary())
    monkeypatch.setattr(packing, "span_hashes", lambda data, s, e: np.zeros(len(s), np.uint64))
    assert [poor.encode(t).tolist() for t in texts + texts] == want + want and len(poor.hash) == 1


def test_memo_is_bounded_in_bytes():
    tok = packing.WordTokenizer(packing.default_vocabulary(), memo=20_000)
    for i in range(20):
        text = " ".join(f"word{i}x{j}" for j in range(100))
        assert tok.encode(text).tolist() == tok.tok.encode(text, add_special_tokens=False).ids
        assert tok._held() < 40_000


def test_jaccard_of_twins(spark):
    a, b = twins(1024)
    rows = [(0, f"w0 w1 w2 w3 {a}"), (1, f"w0 w1 w2 w3 {b}"), (2, f"w0 w1 w2 w3 {a}"), (3, a), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, df).collect()} == brute.jaccard(rows)


def test_repeats_of_twins(spark):
    a, b = twins(2048)
    words = [rng.choice(VOCAB) for _ in range(34)]
    rows = [(0, " ".join([*words, a])), (1, " ".join([*words, b])), (2, "x " + " ".join([*words, b]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows) and [got[i][1] for i in range(3)] == [0, 35, 35]


@pytest.mark.parametrize(("k", "percent"), [(5, 75), (2, 80)])
def test_similar_rows_against_sets(k, percent):
    import pyarrow as pa

    left, right = [], []
    for _ in range(300):
        a = [rng.choice(VOCAB[: rng.choice([3, 300])]) for _ in range(rng.randrange(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 3)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(VOCAB).upper()
        left.append(" ".join(a))
        right.append("\t".join(b))

    def shingled(text):
        w = brute.WORD.findall(text.translate(brute.LOWER))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    want = [bool(x | y) and bool(x & y) and 100 * len(x & y) >= percent * len(x | y) for x, y in ((shingled(a), shingled(b)) for a, b in zip(left, right, strict=True))]
    assert _verify.similar_rows(pa.array(left), pa.array(right), k, percent).tolist() == want and 50 < sum(want) < 290
