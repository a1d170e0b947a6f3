"""Packing: non-negative least squares over length combinations.

Documents become token ids and are cut into whole windows plus one remainder.
The remainders' length histogram (at most `window` bins) goes to the driver.
There, shallow combinations of lengths that fill the window exactly are
enumerated over the histogram, NNLS finds repeat counts whose lengths sum to the
histogram, the counts are rounded down, and what is left is packed greedily,
also as patterns with repeat counts. So the plan's size depends on the window,
never on the number of documents. A piece finds its place by its gapless rank
among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import NOT_ALNUM, U64, distinct, lowered, same_spans, span_hashes, tidy, utf8_chunks, word_spans
from ._scratch import Scratch
from ._spread import gapless_rank

#: MEMO: bytes of the words, with their ids, that a worker remembers.
WINDOW, END_ID, MEMO, CHUNK_BYTES = 4096, 2, 64 << 20, 2 << 20
_ALNUM = ~NOT_ALNUM & (np.arange(256) < 128)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts through a tokenizer that lower-cases and drops white space, word by word with a memo.

    Words are found and hashed as bytes; only the distinct words that the memo
    lacks become strings and are encoded. A full stop or comma after a letter or
    digit is a token of its own and is left off the memo's words. The memo is
    arrays in the order of the hash, with the words' bytes beside them: a word
    is known if its bytes are those remembered, and of two words with one hash
    the second is encoded each time. It is emptied when it holds `memo` bytes.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        # One task is one core; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.size = memo
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = np.zeros(256, "<u4")
        for m in ".,":
            (self.mark[ord(m)],) = self.tok.encode(m, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.hash, self.ids, self.raw = np.zeros(0, U64), np.zeros(0, "<u4"), np.zeros(0, np.uint8)
        self.at, self.n, self.s, self.e = (np.zeros(0, np.int64) for _ in range(4))

    def _held(self) -> int:
        return sum(x.nbytes for x in (self.hash, self.ids, self.raw, self.at, self.n, self.s, self.e))

    def _encode_words(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each string, all ids). Words of letters alone end in one token that closes a word, so many of them go as one text."""
        n = np.zeros(len(words_), np.int64)
        alpha = [i for i, w in enumerate(words_) if w.isalpha()]
        other = [i for i, w in enumerate(words_) if not w.isalpha()]
        out: list[np.ndarray] = []
        order: list[int] = []
        for a in range(0, len(alpha), 5000):
            part = alpha[a : a + 5000]
            ids = np.array(self.tok.encode_batch_fast([" ".join([words_[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                other += part
                continue
            n[part] = np.diff(ends, prepend=0)
            out.append(ids)
            order += part
        for i, e in zip(other, self.tok.encode_batch_fast([words_[i] for i in other], add_special_tokens=False), strict=True):
            n[i] = len(e.ids)
            out.append(np.array(e.ids, "<u4"))
        order += other
        flat = np.concatenate(out) if out else np.zeros(0, "<u4")
        begin = np.zeros(len(words_), np.int64)
        sizes = n[order]
        begin[order] = np.cumsum(sizes) - sizes
        return n, flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(flat))]

    def _read(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._encode_words([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist(), strict=True)])

    def _learn(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Remember words (sorted by hash, none of which the memo has)."""
        n, ids = self._read(data, s, e)
        size = e - s
        end = len(self.raw) + np.cumsum(size)
        index = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.raw = np.concatenate([self.raw, data[index]])
        spot = np.searchsorted(self.hash, h)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, ids])
        for name, new in (("at", at), ("n", n), ("s", end - size), ("e", end), ("hash", h)):
            setattr(self, name, np.insert(getattr(self, name), spot, new))

    def _look_up(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, single: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ids, number of ids, ids) of distinct words, of which the first `single` are sorted by hash."""
        if self._held() > self.size:
            self.forget()

        def known() -> tuple[np.ndarray, np.ndarray]:
            spot = np.searchsorted(self.hash, h)
            here = np.flatnonzero(spot < len(self.hash))
            here = here[self.hash[spot[here]] == h[here]]
            return spot, here

        _, here = known()
        new = np.ones(len(h), bool)
        new[here] = new[single:] = False
        if new.any():
            self._learn(data, h[new], s[new], e[new])
        spot, here = known()
        right = np.zeros(len(h), bool)
        right[here] = same_spans(data, s[here], e[here], self.raw, self.s[spot[here]], self.e[spot[here]])
        at, n, ids = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), self.ids
        at[right], n[right] = self.at[spot[right]], self.n[spot[right]]
        if not right.all():
            count, more = self._read(data, s[~right], e[~right])
            at[~right], n[~right] = len(ids) + np.cumsum(count) - count, count
            ids = np.concatenate([ids, more])
        return at, n, ids

    def encode_chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts within them) of a chunk of texts."""
        data = lowered(data)
        s, e, t = word_spans(data, offs)
        if not len(s):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        marked = (e - s > 1) & (self.mark[data[e - 1]] > 0) & _ALNUM[data[e - 2]]
        tail = np.where(marked, self.mark[data[e - 1]], 0)
        e = e - marked
        h = span_hashes(data, s, e)
        first, back, single = distinct(data, s, e, h)
        at, n, ids = self._look_up(data, h[first], s[first], e[first], single)
        at, n = at[back], n[back]
        full = n + marked
        end = np.cumsum(full)
        begin = end - full
        out = np.empty(int(end[-1]), "<u4")
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin, n) + within] = ids[np.repeat(at, n) + within]
        out[end[marked] - 1] = tail[marked]
        per_text = np.bincount(t, weights=full, minlength=len(offs) - 1).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per_text)])

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_chunk(raw, np.array([0, len(raw)]))[0]


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): whole windows, then the remainder, of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for a, _, data, offs in utf8_chunks(batch.column(1), CHUNK_BYTES):
                flat, ends = tok.encode_chunk(data, offs)
                for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    ids = np.append(flat[lo:hi], np.uint32(END_ID)).astype("<u4")
                    for begin in range(0, len(ids), window):
                        part = ids[begin : begin + window]
                        row.append(a + i)
                        start.append(begin)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
            ids_out = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_out, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], [id_col, "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(cut), f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Multisets of 1 to 3 present lengths that fill the window: all of one and two, and for each length
    three spread choices of a third and, halved on, of a fourth part."""
    present = np.flatnonzero(hist)
    here = set(present.tolist())
    out = {(window,)} if window in here else set()
    for a in present[::-1].tolist():
        rest = window - a
        if rest in here and a >= rest:
            out.add((a, rest))
        if a >= window:
            continue
        low = present[present <= rest]
        for q in (0.25, 0.5, 0.75):
            if not len(low):
                break
            b = int(low[min(len(low) - 1, np.searchsorted(low, rest * q))])
            if rest - b in here:
                out.add(tuple(sorted((a, b, rest - b), reverse=True)))
            for c in low[np.searchsorted(low, (rest - b) // 2) :][:2].tolist():
                if (d := rest - b - c) in here:
                    out.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(out, reverse=True)


def nnls(columns: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Repeat counts x >= 0 of the columns that bring their sum near the histogram, by coordinate descent.

    Exact minimisation over one count at a time, each clipped at 0; the residual is kept up to date.
    """
    residual = hist.astype(float).copy()
    x = np.zeros(len(columns))
    parts = [np.unique(c, return_counts=True) for c in columns]
    norms = [float((k * k).sum()) for _, k in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, (idx, k) in enumerate(parts):
            new = max(0.0, x[j] + float(residual[idx] @ k) / norms[j])
            step = new - x[j]
            if step:
                residual[idx] -= step * k
                x[j] = new
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(hist: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many)], repeats) that use every length exactly as often as hist has it."""
    left = hist.astype(np.int64).copy()
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    columns = combinations(left, window)
    for c, x in zip(columns, nnls(columns, left), strict=True):
        size, k = np.unique(c, return_counts=True)
        n = int(min(np.floor(x + 1e-9), (left[size] // k).min()))
        if n > 0:
            left[size] -= n * k
            patterns.append((list(zip(size[::-1].tolist(), k[::-1].tolist(), strict=True)), n))
    # Best fit on what is left: the longest, then again the longest that still fits. Each pattern is
    # repeated until one of its lengths runs out, so there are at most `window` patterns here.
    while left.any():
        room, used = window, []
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] - _taken(used, room + 1) > 0)
            if not len(fits):
                break
            size = int(fits[-1])
            many = min(int(left[size]) - dict(used).get(size, 0), room // size)
            used.append((size, many))
            room -= size * many
        n = int(min(left[s] // k for s, k in used))
        for s, k in used:
            left[s] -= n * k
        patterns.append((used, n))
    return patterns


def _taken(used: list[tuple[int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for s, k in used:
        if s < n:
            out[s] = k
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, slots, first sequence, first offset): where the pieces of a length go, by rank."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for used, repeats in patterns:
        offset = 0
        for size, k in used:
            first = seen.get(size, 0)
            out.append((size, first, first + k * repeats, k, sequence, offset))
            seen[size] = first + k * repeats
            offset += size * k
        sequence += repeats
    return out


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed once
    each. Empty input: no rows.
    """
    scratch = Scratch(spark, "pack")
    table = scratch.table(pieces(docs, vocabulary or default_vocabulary(), window, id_col, text_col))
    # At most `window` rows.
    hist = np.zeros(window + 1, np.int64)
    for r in table.groupBy("length").agg(F.count("*").alias("n")).collect():
        hist[r["length"]] = r["n"]
    rows = places(plan(hist, window))
    # A table bounded by the window, searched by (length, rank).
    placed = _by_search(gapless_rank(table, ["length"], [id_col, "start"], int(hist.sum()), name="r_"), rows)
    local = F.col("r_") - F.col("first_")
    return placed.select(
        id_col,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence0") + F.floor(local / F.col("slots"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.pmod(local, F.col("slots")) * F.col("length")).cast("long").alias("offset"),
    )


def _by_search(ranked: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """ranked with its spot, by binary search in the plan (a broadcast array bounded by the window)."""
    table = np.array(sorted(rows) or [(0, 0, 1, 1, 0, 0)], np.int64)
    shared = ranked.sparkSession.sparkContext.broadcast(table)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        top = int(t[:, 2].max()) + 1
        keys = t[:, 0] * top + t[:, 1]
        for batch in batches:
            at = np.searchsorted(keys, batch.column("length").to_numpy() * top + batch.column("r_").to_numpy(), "right") - 1
            extra = [pa.array(t[at, j]) for j in (1, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "first_", "slots", "sequence0", "offset0"])

    schema = ranked.select("*", *[F.lit(0).cast("long").alias(c) for c in ("first_", "slots", "sequence0", "offset0")]).schema
    return ranked.mapInArrow(find, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
