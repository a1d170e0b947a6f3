"""Scores of generated text against a reference: BLEU-4, ROUGE-1, ROUGE-L, a stem-free METEOR, distinct-n, self-BLEU."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu(references: list[list[str]], candidate: list[str], order: int = 4, epsilon: float = 0.1) -> float:
    """Clipped n-gram precisions, geometric mean, brevity penalty; a zero precision counts as epsilon matches."""
    if not candidate or not references:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        have = _grams(candidate, n)
        best: Counter = Counter()
        for r in references:
            best |= _grams(r, n)
        total = max(1, sum(have.values()))
        match = sum((have & best).values())
        if n == 1 and not match:
            return 0.0
        logs += math.log((match or epsilon) / total) / order
    closest = min((abs(len(r) - len(candidate)), len(r)) for r in references)[1]
    penalty = 1.0 if len(candidate) > closest else math.exp(1 - closest / len(candidate))
    return penalty * math.exp(logs)


def _f(match: float, a: int, b: int) -> float:
    return 2 * match / (a + b) if a + b and match else 0.0


def rouge1(reference: list[str], candidate: list[str]) -> float:
    return _f(sum((Counter(reference) & Counter(candidate)).values()), len(reference), len(candidate))


def rouge_l(reference: list[str], candidate: list[str]) -> float:
    row = [0] * (len(candidate) + 1)
    for r in reference:
        last = 0
        for j, c in enumerate(candidate, 1):
            last, row[j] = row[j], last + 1 if r == c else max(row[j], row[j - 1])
    return _f(row[-1], len(reference), len(candidate))


def meteor(reference: list[str], candidate: list[str]) -> float:
    """Exact matches only: no stemmer or synonym list is used."""
    spots: dict[str, list[int]] = {}
    for i, r in enumerate(reference):
        spots.setdefault(r, []).append(i)
    aligned = [spots[c].pop(0) for c in candidate if spots.get(c)]
    m = len(aligned)
    if not m:
        return 0.0
    chunks = 1 + sum(b != a + 1 for a, b in zip(aligned, aligned[1:], strict=False))
    p, r = m / len(candidate), m / len(reference)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


def scores(df: DataFrame, keys: list[str], reference: str, response: str) -> DataFrame:
    """keys with bleu, rouge1, rouge_l, meteor of response against reference (split on white space, lower case)."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b in zip(pdf[reference], pdf[response], strict=True):
                x, y = (a or "").lower().split(), (b or "").lower().split()
                rows.append((round(bleu([x], y), 6), round(rouge1(x, y), 6), round(rouge_l(x, y), 6), round(meteor(x, y), 6)))
            out = pd.DataFrame(rows, columns=["bleu", "rouge1", "rouge_l", "meteor"])
            yield pd.concat([pdf[keys].reset_index(drop=True), out], axis=1)

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "bleu double, rouge1 double, rouge_l double, meteor double"])
    return df.select(*keys, reference, response).mapInPandas(run, schema)


def self_bleu(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, self_bleu): each text of a small group against the others, averaged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [(x or "").lower().split() for x in pdf[text]]
        each = [bleu(texts[:i] + texts[i + 1 :], x, epsilon=1e-9) for i, x in enumerate(texts)]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "self_bleu": [round(sum(each) / len(each), 6)]})

    return df.select(group, text).groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, self_bleu double")


def averages(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("bleu", "rouge1", "rouge_l", "meteor")])
