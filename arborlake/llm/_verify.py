"""Similarity of pairs of texts on the words themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._bytes import distinct, lowered, tidy, utf8_chunks, word_spans

#: Bytes of text that are compared at once, but for a single pair that is longer.
BYTES = 2 << 20


def shingle_rows(word: np.ndarray, t: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(numbers that together name a shingle, its text): word numbers (>= 1) packed into as few columns as hold them."""
    n = len(word)
    end = np.searchsorted(t, t, "right")
    begin = np.searchsorted(t, t, "left")
    at = np.arange(n)
    start = np.flatnonzero((at + k <= end) | ((at == begin) & (end - begin < k)))
    bits = max(1, int(word.max(initial=1)).bit_length())
    each = max(1, 63 // bits)
    cols = []
    for first in range(0, k, each):
        col = np.zeros(len(start), np.int64)
        for j in range(first, min(k, first + each)):
            inside = start + j < end[start]
            col = (col << bits) | np.where(inside, word[np.minimum(start + j, n - 1)], 0)
        cols.append(col)
    return cols, t[start]


def similar_rows(left: pa.Array, right: pa.Array, k: int, percent: int) -> np.ndarray:
    """Whether 100 * |A and B| >= percent * |A or B|, for each row's sets of distinct k-word shingles (A-Z in lower case; of fewer words, all as one)."""
    m = len(left)
    _, _, data, offs = next(utf8_chunks(pa.concat_arrays([left, right]), 1 << 62))
    data = lowered(data)
    s, e, t = word_spans(data, offs)
    if not len(s):
        return np.zeros(m, bool)
    cols, owner = shingle_rows(distinct(data, s, e)[1] + 1, t, k)
    pair, side = owner % m, owner // m
    order = np.lexsort((side, *cols, pair))
    pair, side, cols = pair[order], side[order], [c[order] for c in cols]
    first = np.ones(len(pair), bool)
    first[1:] = pair[1:] != pair[:-1]
    for c in cols:
        first[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(first)
    shared = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)
    either = np.bincount(pair[starts], minlength=m)
    both = np.bincount(pair[starts], weights=shared, minlength=m).astype(np.int64)
    return (both > 0) & (100 * both >= percent * either)


def similar_pairs(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of rows (a, b, ta, tb) whose texts are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).fill_null(""), batch.column(3).fill_null("")
            size = pc.add(pc.binary_length(left).cast(pa.int64()), pc.binary_length(right).cast(pa.int64())).to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(end, (end[a] - size[a]) + BYTES, "right")))
                ok = similar_rows(left.slice(a, b - a), right.slice(a, b - a), k, percent)
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a).filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])
                a = b

    return rows.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")
