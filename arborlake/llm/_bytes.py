"""Words and hashes over the raw UTF-8 of an Arrow string column, in numpy.

A text never becomes a Python string here. A word is a run of bytes other than
space and 0x09-0x0D. Its hash is the sum of a finaliser over its 8-byte blocks,
each under a key that belongs to the block's place: all words of a chunk are
hashed by a handful of array operations, and repeated or alternating blocks do
not cancel, as they do in a polynomial modulo 2^64. `distinct` tells words apart
by their bytes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20
_GOLDEN = U64(0x9E3779B97F4A7C15)
#: The low n bytes of a block.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of plain words: ASCII other than letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers: dict[int, np.ndarray] = {}


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives memory back to the system: workers are kept for later tasks, and idle ones should hold little."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64; kept between calls up to a few chunks."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within the bytes): whole texts, about limit bytes. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, text index) of each word, in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[data]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def _loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _blocks_after(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, number in its span) of all blocks but the first of spans of more than 8 bytes."""
    more = (e - s - 1) >> 3
    number = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    at = np.repeat(s, more) + 8 * number
    return at, np.minimum(np.repeat(e, more) - at, 8), number


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the spans; those of two lanes are independent."""
    size, load = e - s, _loads(data)
    keys = mix(np.array([lane], U64) * U64(0xD1B54A32D192ED03) + _GOLDEN)
    h = mix((load[s] & _MASK[np.minimum(size, 8)]) ^ keys)
    long = np.flatnonzero(size > 8)
    if len(long):
        at, n, number = _blocks_after(s[long], e[long])
        more = (size[long] - 1) >> 3
        h[long] += np.add.reduceat(mix((load[at] & _MASK[n]) ^ mix(keys + number.astype(U64) * _GOLDEN)), np.cumsum(more) - more)
    return mix(h + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def same_spans(a: np.ndarray, sa: np.ndarray, ea: np.ndarray, b: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Whether a[sa:ea] and b[sb:eb] are equal, byte by byte."""
    same = (ea - sa) == (eb - sb)
    la, lb = _loads(a), _loads(b)
    same &= ((la[sa] ^ lb[sb]) & _MASK[np.minimum(ea - sa, 8)]) == 0
    long = np.flatnonzero(same & (ea - sa > 8))
    if len(long):
        at, n, _ = _blocks_after(sa[long], ea[long])
        bt, _, _ = _blocks_after(sb[long], eb[long])
        more = (ea[long] - sa[long] - 1) >> 3
        same[long] = np.logical_and.reduceat(((la[at] ^ lb[bt]) & _MASK[n]) == 0, np.cumsum(more) - more)
    return same


def distinct(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(one span of each distinct word, which of them each span is, how many of the former have a hash of their own).

    Hashes only group the spans; the bytes decide. Words whose hash another word
    has too come last.
    """
    own, first, back = np.unique(span_hashes(data, s, e) if h is None else h, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_spans(data, s, e, data, s[first][back], e[first][back]))
    if len(odd):
        named: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            word = data[s[i] : e[i]].tobytes()
            if word not in named:
                named[word] = len(own) + len(more)
                more.append(i)
            back[i] = named[word]
        first = np.concatenate([first, np.array(more)])
    return first, back, len(own)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, text index) of each word, in order."""
    if lower:
        data = lowered(data)
    s, e, t = word_spans(data, offs)
    return span_hashes(data, s, e, lane), s, e, t


def ngrams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i (len(h)-n+1 of them, may be none)."""
    if len(h) < n:
        return np.zeros(0, U64)
    c = powers(0xA0761D6478BD642F | 5, n + 1)
    out = np.zeros(len(h) - n + 1, U64)
    for j in range(n):
        out += h[j : j + len(out)] * c[j + 1]
    return mix(out + U64(seed))
