"""Periodic runs of words, and texts without the repetitions.

A run is a maximal stretch of words with smallest period q that is at least
EXPONENT * q and MIN_LENGTH words long. Such a run holds two words q apart of
which the first stands on a multiple of (EXPONENT - 1) * q, so a text of n words
has a harmonic number of (period, grid point) pairs to look at, n log n in all.
For all pairs of a chunk of texts at once, numpy drops those whose words differ
and binary-searches how far both sides go on alike, on prefix hashes modulo
2^61 - 1 with a base drawn for the job. What is found is reduced to distinct
stretches with their smallest period and verified on the words; a text in which
a hash lied is searched again without hashes.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import distinct, tidy, utf8_chunks, word_spans
from ._scratch import bound_batches

MIN_LENGTH, EXPONENT = 6, 4
#: Pairs, or words, that are looked at together.
SLICE = 1 << 20
_P = np.uint64((1 << 61) - 1)
_LOW30, _LOW31, _LOW32 = (np.uint64((1 << b) - 1) for b in (30, 31, 32))
U64 = np.uint64

#: (id, number of words) -> which word stands at each place, or None for the text as it is.
Reread = Callable[[int | None, int], np.ndarray | None]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo 2^61 - 1."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(U64(2) * (a1 * b1) + (mid >> U64(30)) + ((mid & _LOW30) << U64(31)) + a0 * b0)


class Prefixes:
    """Hashes of all stretches of a sequence of numbers."""

    def __init__(self, word: np.ndarray, base: int):
        self.word = word
        power = np.ones(1, U64)
        step = base
        while len(power) < len(word) + 1:
            power = np.concatenate([power, _times(power, U64(step))])
            step = step * step % int(_P)
        self.power = power
        term = _times(word.astype(U64) + U64(1), power[: len(word)])
        high, low = np.cumsum(term >> U64(32)), np.cumsum(term & _LOW32)
        self.sum = np.concatenate([np.zeros(1, U64), _reduced(_times(_reduced(high), U64(1 << 32)) + _reduced(low))])

    def _stretch(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _reduced(self.sum[a + n] + _P - self.sum[a])

    def reach(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i < j on (or, back, before them) are alike, at most limit; never too few."""
        low, high = np.zeros(len(i), np.int64), limit.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live] + 1) >> 1
            a, b = (i[live] - mid, j[live] - mid) if back else (i[live], j[live])
            same = _times(self._stretch(a, mid), self.power[b - a]) == self._stretch(b, mid)
            low[live[same]] = mid[same]
            high[live[~same]] = mid[~same] - 1
            live = live[low[live] < high[live]]
        return low


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period, by start and period. All periods of a stretch of 4 of them are multiples of the smallest."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _slices(count: np.ndarray) -> Iterator[slice]:
    """Consecutive entries of about SLICE together."""
    end = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(end, (end[a] - count[a]) + SLICE, "right")))
        yield slice(a, b)
        a = b


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def runs(word: np.ndarray, ends: np.ndarray, base: int = 1_000_003) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of a chunk, by start and period. word: numbers that are equal for equal words; ends: where each text ends."""
    begin = np.concatenate([[0], ends[:-1]])
    size = ends - begin
    periods = np.where(size >= MIN_LENGTH, size // EXPONENT, 0)
    text = np.repeat(np.arange(len(size)), periods)
    q = _within(periods) + 1
    step = (EXPONENT - 1) * q
    points = (size[text] - 1 - q) // step + 1
    pre = Prefixes(word, base)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in _slices(points):
        count = points[part]
        t, p = np.repeat(text[part], count), np.repeat(q[part], count)
        i = begin[t] + _within(count) * (EXPONENT - 1) * p
        # Both words are alike, and so are those on one side of them: the stretch has 3 such places at least.
        same = word[i] == word[i + p]
        t, p, i = t[same], p[same], i[same]
        j = i + p
        left, right = np.maximum(i - 1, 0), np.minimum(j + 1, len(word) - 1)
        near = ((i > begin[t]) & (word[left] == word[left + p])) | ((j + 1 < ends[t]) & (word[right] == word[right - p]))
        t, p, i, j = t[near], p[near], i[near], j[near]
        start = i - pre.reach(i, j, i - begin[t], True)
        end = j + pre.reach(i, j, ends[t] - j, False)
        long = end - start >= np.maximum(MIN_LENGTH, EXPONENT * p)
        if long.any():
            found.append(_smallest(start[long], end[long], p[long]))
    z = np.zeros(0, np.int64)
    start, end, period = _smallest(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (z, z, z)
    lied = np.unique(np.searchsorted(ends, start[~_verified(word, begin, ends, start, end, period)], "right"))
    if len(lied):
        mine = np.isin(np.searchsorted(ends, start, "right"), lied)
        again = [_plain_runs(word, int(begin[t]), int(ends[t])) for t in lied]
        start, end, period = _smallest(*(np.concatenate([x[~mine], *more]) for x, more in zip((start, end, period), zip(*again, strict=True), strict=True)))
    return start, end, period


def _verified(word: np.ndarray, begin: np.ndarray, ends: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each stretch has its period, and no neighbouring word goes on with it."""
    t = np.searchsorted(ends, start, "right")
    size = end - start - period
    before, after = np.maximum(start - 1, 0), np.minimum(end, len(word) - 1)
    ok = (start == begin[t]) | (word[before] != word[before + period])
    ok &= (end == ends[t]) | (word[after] != word[after - period])
    for part in _slices(size):
        at = np.repeat(start[part], size[part]) + _within(size[part])
        same = word[at] == word[at + np.repeat(period[part], size[part])]
        ok[part] &= np.logical_and.reduceat(same, np.cumsum(size[part]) - size[part])
    return ok


def _plain_runs(word: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of word[begin:end], period by period, without hashes."""
    out = [(np.zeros(0, np.int64),) * 3]
    for q in range(1, (end - begin) // EXPONENT + 1):
        alike = np.concatenate([[False], word[begin : end - q] == word[begin + q : end], [False]])
        edge = np.flatnonzero(alike[1:] != alike[:-1])
        start, stop = edge[::2] + begin, edge[1::2] + begin + q
        long = stop - start >= max(MIN_LENGTH, EXPONENT * q)
        out.append((start[long], stop[long], np.full(int(long.sum()), q)))
    return _smallest(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _kept_words(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) == 0


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The spans with a space after each."""
    size = e - s + 1
    end = np.cumsum(size)
    out = data[np.minimum(np.repeat(s, size) + _within(size), len(data) - 1)] if len(s) else np.zeros(0, np.uint8)
    out[end - 1] = 0x20
    return out


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
TEXTS = "runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def _rows(word: np.ndarray, ends: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray, base: int, texts: bool) -> list[pa.Array]:
    start, end, period = runs(word, ends, base)
    begin = np.concatenate([[0], ends[:-1]])
    t = np.searchsorted(ends, start, "right")
    length, start0 = end - start, start - begin[t]
    m = len(ends)
    n = np.bincount(t, minlength=m)
    # The longest run of each text, the first of equally long ones.
    order = np.lexsort((period, start, -length, t))
    lead = order[np.searchsorted(t[order], np.flatnonzero(n))]
    best = np.full((3, m), -1)
    best[:, t[lead]] = start0[lead], length[lead], period[lead]
    none = n == 0
    lines = [f"{a},{b},{c}\n" for a, b, c in zip(start0.tolist(), length.tolist(), period.tolist(), strict=True)]
    cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
    told = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
    keep = _kept_words(len(word), start, end, period)
    flat = _joined(data, s[keep], e[keep])
    size = np.where(keep, e - s + 1, 0)
    total = np.concatenate([[0], np.cumsum(size)])
    raw = memoryview(flat)
    kept = [raw[a : max(a, b - 1)] for a, b in zip(total[begin].tolist(), total[ends].tolist(), strict=True)]
    cols = [pa.array(n.astype(np.int64)), *(pa.array(x, pa.int64(), mask=none) for x in best)]
    cols.append(pa.array(1000 * best[1] // best[2], pa.int64(), mask=none))
    cols += [pa.array(told, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
    if texts:
        each = pa.StructArray.from_arrays([pa.array(x) for x in (start0, length, period)], ["start", "length", "period"])
        cols += [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each), pa.array([bytes(x).decode("utf-8", "replace") for x in kept], pa.string())]
    return cols


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reread: Reread | None = None, texts: bool = True) -> DataFrame:
    """One row per row of docs: id, n_runs, the longest run (first of equally long ones), digests, and with `texts` all runs and the collapsed text.

    A word is dropped from the collapsed text if a run contains it after that
    run's first period; kept words are joined by one space. Null, empty and
    wordless texts have no runs, nulls for the longest one and an empty collapsed
    text; so have texts of fewer than MIN_LENGTH words, whose words all stay.
    Texts of any length are searched whole, in slices. Ids are cast to long; rows
    with equal ids or without one are rows like others. Other columns are
    ignored, whatever their names. Empty input: no rows. Nothing is shuffled.
    """
    base = random.SystemRandom().randrange(1 << 20, int(_P) - 1)
    names = [c.split(" ", 1)[0] for c in (COLUMNS + (", " + TEXTS if texts else "")).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in utf8_chunks(batch.column(1)):
                s, e, t = word_spans(data, offs)
                ends = np.cumsum(np.bincount(t, minlength=b - a))
                ids = batch.column(0).slice(a, b - a)
                if reread is not None:
                    at = np.arange(len(s))
                    for x, lo, hi in zip(ids.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                        other = reread(x, hi - lo)
                        if other is not None:
                            at[lo:hi] = lo + other
                    s, e = s[at], e[at]
                word = distinct(data, s, e)[1] if len(s) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([ids, *_rows(word, ends, data, s, e, base, texts)], [id_col, *names])

    bound_batches(docs.sparkSession)
    schema = f"`{id_col}` long, {COLUMNS}" + (f", {TEXTS}" if texts else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), schema)


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of a text that the query's contract makes periodic: one in ten ids, from word a on with period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), reread=looped, texts=False)
