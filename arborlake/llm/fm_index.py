"""An FM-index over integer sequences: suffix order by prefix doubling, BWT in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class FMIndex:
    """Counts occurrences of patterns (arrays of symbols >= 1, up to `depth` long) by backward search.

    Symbol 0 separates texts. Suffixes are ordered by their first `depth` symbols
    at least, which is all that patterns of that length depend on.
    """

    def __init__(self, text: np.ndarray, depth: int = 128):
        n = len(text)
        self.n = n
        self.sigma = int(text.max(initial=0)) + 1
        rank = text.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        span = 1
        while span < depth:
            tail = np.full(n, -1, np.int64)
            tail[: n - span] = rank[span:] if span < n else []
            key = rank * (n + 1) + tail + 1
            order = np.argsort(key)
            key = key[order]
            new = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if n else key
            rank = np.empty(n, np.int64)
            rank[order] = new
            span *= 2
            if not n or new[-1] == n - 1:
                break
        bwt = text[order - 1] if n else text
        self.count = np.bincount(text, minlength=self.sigma)
        self.before = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        seq = bwt.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int32))[:-1]]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self._descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            w = i >> 6
            below = (U64(1) << (i & 63).astype(U64)) - U64(1)
            ones = self.ranks[k][w] + np.bitwise_count(self.words[k][w] & below)
            i = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of symbol + pattern, from those of the patterns."""
        m = len(symbol)
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.before[symbol] - self.base[symbol]
        return both[:m] + shift, both[m:] + shift


def repeated_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to): windows of text[start:start + size], by first symbol, that occur twice or more in the index.

    All segments advance together. Each searches backward from an end; while the
    string read occurs again, every window in it does. When it turns out unique,
    no window around it repeats, and the search resumes at the next possible end.
    """
    seg = np.arange(len(start))
    end = size - 1
    live = end >= window - 1
    seg, end = seg[live], end[live]
    at, low, high = end.copy(), np.zeros(len(seg), np.int64), np.full(len(seg), index.n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(seg):
        symbol = text[start[seg] + at]
        low, high = index.extend(symbol, low, high)
        unique = high - low < 2
        done = ~unique & (at == 0)
        stop = unique | done
        if stop.any():
            first = np.where(done, 0, at + 1)[stop]
            e, s = end[stop], seg[stop]
            long = e - first + 1 >= window
            found.append((s[long], first[long], e[long] - window + 2))
            alone = index.count[symbol[stop]] < 2
            nxt = np.where(long, np.minimum(e - 1, first + window - 2), np.where(alone, at[stop] - 1, e - 1))
            nxt[done[stop]] = -1
            end[stop], at[stop], low[stop], high[stop] = nxt, nxt, 0, index.n
            go = ~stop
            go[stop] = nxt >= window - 1
            at[~stop] -= 1
            seg, end, at, low, high = seg[go], end[go], at[go], low[go], high[go]
        else:
            at -= 1
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
