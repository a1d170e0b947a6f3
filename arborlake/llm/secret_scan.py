"""Secret scan: three pattern kinds, and sliding-window entropy for what has no pattern."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ._scratch import bound_batches

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
WINDOW = 20
#: Bits a character that a window must reach, by the class of the whole candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Candidates that are no secrets: UUIDs, dates and numbers, plain words joined by marks, one repeated mark.
ALLOW = [
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[A-Z]+|(?:[A-Z]?[a-z]{2,}+)++"),
    re.compile(r"(?:[A-Za-z]+[0-9]{0,4}[-_/+=]+)+[A-Za-z]*[0-9]{0,4}"),
]


def _weights(window: int) -> list[float]:
    """c * log2(c) of the counts in a window, and of one more: a character enters before one leaves."""
    return [0.0] + [c * math.log2(c) for c in range(1, window + 2)]


_CLOGC = _weights(WINDOW)


def char_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def entropy_spans(s: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal unions of windows whose entropy reaches the threshold; counts change by two characters a step."""
    counts: dict[str, int] = {}
    weight = _CLOGC if window == WINDOW else _weights(window)
    weighted, spans = 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        weighted += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        if i >= window:
            old = s[i - window]
            c = counts[old]
            weighted += weight[c - 1] - weight[c]
            counts[old] = c - 1
        if i >= window - 1 and math.log2(window) - weighted / window >= threshold:
            begin = i - window + 1
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((begin, i + 1))
    return spans


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = _merged((a, b) for _, a, b in found)
    at = 0
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any(a.fullmatch(s) for a in ALLOW):
            continue
        for a, b in entropy_spans(s, THRESHOLDS[char_class(s)]):
            a, b = a + m.start(), b + m.start()
            # Spans come in order, as the base does: both lists are walked once.
            while at < len(base) and base[at][1] <= a:
                at += 1
            if at == len(base) or base[at][0] >= b:
                found.append(("entropy", a, b))
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    base_sha256 digests the pattern kinds' spans only. Null and empty texts have
    no spans; texts of any length are read whole, in time that grows with the
    length. Rows are independent: repeated rows give repeated results. Other
    columns are ignored, whatever their names. Empty docs: no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text_"]:
                spans = find_secrets(text)
                kinds = [k for k, _, _ in spans]
                base = _join([s for s in spans if s[0] != "entropy"])
                rows.append((*(kinds.count(k) for k in ORDER), hashlib.sha256(base.encode()).hexdigest(), _join(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])
            out.insert(0, id_col, pdf["id_"].to_numpy() if len(pdf) else [])
            yield out

    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(docs[id_col].alias("id_"), docs[text_col].alias("text_"))
    return narrow.mapInPandas(scan, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
