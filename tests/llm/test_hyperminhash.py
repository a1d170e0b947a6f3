import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import hyperminhash as hm
from arborlake.llm.jaccard_join import shingles

rng = random.Random(2)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, words=400):
    return [rng.choice(VOCAB[:words]) for _ in range(n)]


def edited(words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"x{rng.randrange(10**6)}"
    return out


def texts():
    out = [None, "", " \n", "one", "One", "two words", "two  words", "two words two words"]
    # Around the threshold, of all sizes; short ones share common pairs.
    for n in (3, 4, 5, 6, 8, 10, 12, 13, 14, 16, 20, 40, 90, 160, 300, 900):
        for _ in range(6):
            base = prose(n, rng.choice([5, 400]))
            out += [" ".join(base), " ".join(base + prose(1)), " ".join(edited(base, 0.05)), " ".join(edited(base, 0.08)), " ".join(edited(base, 0.02)).upper()]
    out += ["the same pair " + " ".join(prose(rng.randrange(1, 6))) for _ in range(60)]
    base = prose(200)
    chain = [base]
    for _ in range(8):
        chain.append(edited(chain[-1], 0.06))
    out += [" ".join(c) for c in chain] + [" ".join(base)] * 30 + [" ".join(prose(30_000))]
    return out


@pytest.mark.parametrize("rounds", [0, hm.ROUNDS])
def test_components_against_brute_force(spark, rounds):
    rows = list(enumerate(texts()))
    extra = {c: F.lit("x") for c in ("node", "id_", "key", "side", "n", "kept", "bits", "need")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hm.near_components(spark, df, rounds=rounds, cell_rows=20).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute.jaccard(rows, 2, 80).items()}
    assert got == want and 100 < sum(not v[2] for v in want.values()) < len(want) - 100


def test_every_row_and_empty_tables(spark):
    base = prose(100)
    near = edited(base, 0.03)
    rows = [(1, " ".join(base)), (1, " ".join(base)), (None, " ".join(near)), (None, "all alone here"), (7, None), (7, ""), (9, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in hm.near_components(spark, df).collect())))
    n, m = (len(brute.shingle_set(" ".join(x), 2)) for x in (base, near))
    assert got == sorted(map(repr, [(1, n, 1, True), (1, n, 1, True), (None, m, 1, False), (None, 2, None, True), (7, 0, 7, True), (7, 0, 7, True), (9, m, 1, False)]))
    assert hm.near_components(spark, df.limit(0)).count() == 0


def _sketch(sets):
    """Registers of sets of numbers."""
    s = np.concatenate([np.sort(np.array(list(x), np.uint64)) for x in sets])
    t = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return hm.registers(s, t, len(sets))


def _pair(n, similarity):
    """Two sets of about n random hashes."""
    both = round(2 * n * similarity / (1 + similarity))
    draw = lambda k: {rng.getrandbits(64) for _ in range(k)}
    common = draw(both)
    return common | draw(n - both), common | draw(n - both)


def test_registers_hold_zeros_and_mantissa():
    x = np.array([1 << 63, (1 << 63) | (1 << 53), 1 << 62, 3, 1, (1 << 64) - 1], np.uint64)
    # The least of a bucket is seen after a finaliser; of one shingle, its own.
    for v in x:
        reg = hm.registers(np.array([v]), np.zeros(1, np.int64), 1)
        y = int(hm.mix(np.array([v ^ np.uint64(0x2545F4914F6CDD1D)]))[0])
        zeros = 64 - y.bit_length()
        assert reg[reg > 0].tolist() == [((zeros + 1) << 10) | ((y << (zeros + 1)) & ((1 << 64) - 1)) >> 54]


@pytest.mark.parametrize("n", [30, 200, 3000, 40_000])
def test_registers_estimate_and_never_miss(n):
    sketches, allowed = [], []
    for similarity in (0.8, 0.3):
        for _ in range(60):
            a, b = _pair(n, similarity)
            reg = _sketch([a, b])
            told = np.count_nonzero((reg[0] == reg[1]) & (reg[0] > 0)) / np.count_nonzero(reg[0] | reg[1])
            sketches.append((similarity, told))
            allowed.append((similarity, bool(hm.registers_allow(reg[:1], reg[1:], np.array([len(a) + len(b)]))[0])))
            if similarity == 0.8:
                assert set(hm.band_keys(reg[:1])[0].tolist()) & set(hm.band_keys(reg[1:])[0].tolist())
    for similarity in (0.8, 0.3):
        assert abs(np.mean([t for s, t in sketches if s == similarity]) - similarity) < 0.03
    assert all(ok for s, ok in allowed if s == 0.8)
    assert not any(ok for s, ok in allowed if s == 0.3) or n < 200


def test_parities_bound_the_difference():
    for n in (10, 300, 900):
        a, b = _pair(n, 0.7)
        s = np.concatenate([np.sort(np.array(list(x), np.uint64)) for x in (a, b)])
        rows = hm.parities(s, np.repeat([0, 1], [len(a), len(b)]), 2)
        differ = int(np.bitwise_count(rows[0] ^ rows[1]).sum())
        assert differ <= len(a ^ b) and differ % 2 == len(a ^ b) % 2 and differ > 0.7 * len(a ^ b)


def test_near_copies_below_the_threshold_make_few_pairs(spark, monkeypatch):
    # Each has edits of its own, at a similarity of about 0.7 to every other one.
    made = []
    linked = hm._linked
    monkeypatch.setattr(hm, "_linked", lambda s, pairs, *more: (made.append(pairs.count()), linked(s, pairs, *more))[1])
    base = prose(200)
    rows = [(i, " ".join(edited(base, 0.05))) for i in range(400)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hm.near_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows, 2, 80) and sum(made) < 4000


def test_expected_collisions_of_disjoint_sets():
    n, seen = 4000, 0
    for _ in range(400):
        reg = _sketch([{rng.getrandbits(64) for _ in range(n)}, {rng.getrandbits(64) for _ in range(n)}])
        seen += np.count_nonzero((reg[0] == reg[1]) & (reg[0] > 0))
    want = float(hm.expected_collisions(np.array([2 * n]))[0]) * 400
    assert 0.3 * want < seen + 1 < 3 * want + 3


def test_shingles_are_pairs():
    data = np.frombuffer(b"a b a b c", np.uint8)
    s, t, _ = shingles(data, np.array([0, len(data)]), 2)
    assert len(s) == 3


def test_keys_shared_by_chance_are_dropped_before_texts_are_read(spark, monkeypatch):
    # Pairs of texts with a fifth of their word pairs in common: about a quarter of them share a key. One pair is similar.
    read = []
    sets = hm._sets
    monkeypatch.setattr(hm, "_sets", lambda texts, seed: read.append(texts.count()) or sets(texts, seed))
    rows = [(d, " ".join([*(f"c{d // 2}w{i}" for i in range(101)), *(f"d{d}w{i}" for i in range(200))])) for d in range(200)]
    rows += [(300, rows[7][1] + " more")]
    got = {r.doc_id: r.component_id for r in hm.near_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 7 if d == 300 else d for d, _ in rows}
    assert len(read) == 1 and 2 <= read[0] < 24, read


def test_partners_of_a_key():
    key = np.array([1, 1, 1, 2, 2, 3, 3, 3, 4, 5, 5])
    n = np.array([100, 110, 300, 100, 126, 900, 900, 900, 50, 100, 100])
    sign = np.zeros((11, 2), np.int64)
    # The highest bit makes a number negative; it is one bit like others.
    sign[1, 0] = np.iinfo(np.int64).min
    sign[6] = -1
    sign[7] = (1 << hm.ODD) - 1, 0
    sign[10, 0] = (1 << 23) - 1
    assert hm.partnered(key, n, sign).tolist() == [True, True, False, False, False, True, False, True, False, False, False]


@pytest.mark.parametrize("cell_rows", [5, 8192])
def test_large_keys_pass_and_marks_lose_nothing(spark, cell_rows):
    rows = [(i, 0, 1, i % 7, 40 - i % 7, 100, 0, 0) for i in range(200)] + [(200, 0, 1, 9, 1, 100, 0, 0)]
    df = spark.createDataFrame(rows, "node long, side byte, need long, key long, c long, n long, s0 long, s1 long")
    assert sorted(r.node for r in hm._partnered(df, cell_rows).collect()) == list(range(200))
    docs = spark.range(5000).withColumnRenamed("id", "k_")
    wanted = docs.where("k_ % 50 = 3")
    likely = {r.k_ for r in hm._likely(docs, wanted, "k_").collect()}
    assert {r.k_ for r in wanted.collect()} <= likely and len(likely) < 1500
    assert hm._likely(docs, wanted.limit(0), "k_").count() == 0
