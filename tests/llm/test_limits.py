"""Many languages, and secrets that only their entropy tells."""

import random
import string

import duckdb
import pytest

from arborlake.llm import language_id, secret_scan

rng = random.Random(4)


def test_three_hundred_languages(spark):
    # Each language has letters of its own.
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3 * 300)]
    word = lambda i: "".join(rng.choice(letters[3 * i : 3 * i + 3]) for _ in range(5))
    rows = [(j, " ".join(word(j % 300) for _ in range(8)), f"l{j % 300:03d}") for j in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = language_id.train(df.where("doc_id < 900"), buckets=1 << 12)
    assert len(langs) == matrix.shape[1] == 300
    got = language_id.predict(spark, df.where("doc_id >= 900"), langs, matrix).collect()
    assert len(got) == 300 and sum(r.lang == r.lang_pred for r in got) > 290
    with pytest.raises(ValueError, match="max_langs"):
        language_id.train(df, max_langs=299)


def test_counts_do_not_depend_on_how_they_are_held(spark, monkeypatch):
    rows = [(j, " ".join(rng.choice(["the", "der", "le", "und", "and", "et"]) for _ in range(30)), "abc"[j % 3]) for j in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = language_id.train(df)
    monkeypatch.setattr(language_id, "_HELD", 5)
    again = language_id.train(df)
    assert again[0] == langs and (again[1] == matrix).all()


def _plain_entropy(text):
    """Entropy spans, each compared with every base span."""
    spans = secret_scan.find_secrets(text)
    base = [s for s in spans if s[0] != "entropy"]
    out = []
    for m in secret_scan.CANDIDATE.finditer(text):
        if any(a.fullmatch(m.group()) for a in secret_scan.ALLOW):
            continue
        for a, b in secret_scan.entropy_spans(m.group(), secret_scan.THRESHOLDS[secret_scan.char_class(m.group())]):
            if not any(x < b + m.start() and a + m.start() < y for _, x, y in base):
                out.append(("entropy", a + m.start(), b + m.start()))
    return out


def _key(kind, n):
    alphabet = {"base64": string.ascii_letters + string.digits + "+/", "alnum": string.ascii_letters + string.digits, "hex": "0123456789ABCDEF"}[kind]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_spans_beside_patterns():
    parts = ["token=" + _key("alnum", 30), _key("alnum", 30), "AKIA" + _key("hex", 20), _key("hex", 40).lower(), _key("base64", 40), "plain words", "password: x"]
    for _ in range(60):
        text = rng.choice([" ", "/", "=", ","]).join(rng.choice(parts) for _ in range(25))
        assert [s for s in secret_scan.find_secrets(text) if s[0] == "entropy"] == _plain_entropy(text)


@pytest.mark.parametrize("kind, n", [("base64", 40), ("base64", 24), ("alnum", 32), ("hex", 40)])
def test_planted_secrets_are_found(kind, n):
    """Secrets without a pattern in running text: nearly all are found, in the places where they stand."""
    found = 0
    for _ in range(200):
        secret = _key(kind, n)
        before = "the quick brown fox wrote a letter about international standards and "
        text = before + secret + " which nobody should have seen in 2024-01-31T10:00:00"
        spans = [(a, b) for k, a, b in secret_scan.find_secrets(text) if k == "entropy"]
        assert all(len(before) <= a < b <= len(before) + n for a, b in spans)
        found += bool(spans)
    assert found >= 190


def test_no_entropy_spans_in_clean_texts():
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()]
    odd = [t[a:b] for t in texts for k, a, b in secret_scan.find_secrets(t) if k == "entropy"]
    assert len(texts) > 100 and not odd
