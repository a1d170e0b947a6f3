"""Substring dedup: every word under a repeated 35-word window goes, found with FM-indexes per shard.

Streaming each document through every shard's index would cost documents x
shards, so shards are made by content. A window's anchor is its smallest 8-gram
hash (leftmost if tied), the same wherever the window stands; consecutive
windows with one anchor form a run. Two equal windows have equal anchors, so
only runs whose anchor repeats are candidates, and all of them meet in the
anchor's shard. Runs that are alike as a whole (by anchor and a fingerprint, two
independent 64-bit hashes) enter the index twice, however many there are, and
are searched once. In a shard, an FM-index over these runs is searched backward
for each of them: its matching statistics tell which windows occur again. Runs
travel to their shard as text, and the index's symbols are words told apart by
their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, distinct, mix, ngrams, powers, span_hashes, tidy, utf8_chunks, word_spans, words
from ._owners import BLOCK, repeated, send, to_batch, wire_schema
from ._scratch import Scratch
from ._spread import keyed, split_join
from .fm_index import FMIndex, repeated_windows

WINDOW, GRAM = 35, 8
_BASE = 0xC2B2AE3D27D4EB4F | 5
_INV = pow(_BASE, -1, 1 << 64)
_POS = U64((1 << 24) - 1)
#: 8-grams whose smallest are sought at once; their places must fit under _POS.
STRETCH = 1 << 23


def _smallest(g: np.ndarray, grams: int) -> np.ndarray:
    """Place of the smallest of each `grams` consecutive hashes (by their upper 40 bits, the leftmost if tied)."""
    low = (g & ~_POS) | np.arange(len(g)).astype(U64)
    n = len(g) - grams + 1
    span = 1
    while 2 * span <= grams:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return (np.minimum(low[:n], low[grams - span : grams - span + n]) & _POS).astype(np.int64)


def runs(data: np.ndarray, offs: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first word in the text, windows, anchor, fingerprint) of each run of windows with one anchor."""
    h, s, e, t = words(data, offs)
    n = len(h) - window + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, z, z.astype(U64), z.astype(U64)
    g = ngrams(h, GRAM, 77)
    grams = window - GRAM + 1
    at = np.concatenate([i + _smallest(g[i : i + STRETCH + grams - 1], grams) for i in range(0, n, STRETCH)])[:n]
    valid = t[:n] == t[window - 1 :]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (t[1:n] != t[: n - 1])
    a = np.flatnonzero(first)
    stop = np.flatnonzero(valid & np.concatenate([first[1:] | ~valid[1:], [True]]))
    prefix = np.zeros(len(h) + 1, U64)
    np.cumsum(span_hashes(data, s, e, 1) * powers(_BASE, len(h)), out=prefix[1:])
    count = stop - a + 1
    print_ = mix((prefix[stop + window] - prefix[a]) * powers(_INV, len(h) + 1)[a] + count.astype(U64))
    size = np.bincount(t, minlength=len(offs) - 1)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    return t[a], a - begin[t[a]], count, g[at[a]], print_


def _find_runs(docs: DataFrame, owners: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(6)]
        n_rows = n_runs = 0

        def flush() -> pa.RecordBatch:
            nonlocal n_rows
            key, unit, *rest = (np.concatenate(x) for x in held)
            for x in held:
                x.clear()
            n_rows = 0
            return to_batch(send(key, unit, rest, owners, int(rest[0][0]) if len(key) else 0), ["doc", "first", "n", "side"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offs in utf8_chunks(batch.column(1)):
                t, first, n, anchor, print_ = runs(data, offs, window)
                unit = np.arange(n_runs, n_runs + len(t))
                n_runs += len(t)
                for side, key in enumerate((mix(anchor), mix(print_ ^ U64(0x1234567)))):
                    for x, v in zip(held, (key, unit, ids[a:b][t], first.astype(np.int32), n.astype(np.int8), np.full(len(t), side, np.int8)), strict=True):
                        x.append(v)
                n_rows += 2 * len(t)
                if n_rows >= BLOCK:
                    yield flush()
        if n_rows:
            yield flush()

    return docs.mapInArrow(tidy(run), wire_schema(["doc", "first", "n", "side"]))


def _spaced(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """The spans with a space after each."""
    size = e - s + 1
    end = np.cumsum(size)
    index = np.repeat(s - (end - size), size) + np.arange(int(end[-1]))
    out = data[np.minimum(index, len(data) - 1)]
    out[end - 1] = 0x20
    return out.tobytes()


def _segments(wanted: DataFrame, shards: int, window: int) -> DataFrame:
    """(shard, docs, firsts, counts, search, text): the wanted runs' words, a space after each, packed per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(2)
            for a, b, data, offs in utf8_chunks(batch.column(1)):
                s, e, t = word_spans(data, offs)
                begin = np.searchsorted(t, np.arange(b - a))
                part = lists.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), part.value_lengths().fill_null(0).to_numpy())
                flat = part.flatten()
                first, n, search = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
                anchor = flat.field(3).to_numpy(zero_copy_only=False).view(np.uint64)
                shard = ((anchor >> U64(33)) % U64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                rows = []
                for own in np.split(order, cuts) if len(order) else []:
                    size = n[own].astype(np.int64) + window - 1
                    lo = begin[owner[own]] + first[own]
                    idx = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                    rows.append((int(shard[own[0]]), ids[a:b][owner[own]].tobytes(), first[own].astype(np.int32).tobytes(), n[own].astype(np.int8).tobytes(), search[own].astype(np.int8).tobytes(), _spaced(data, s[idx], e[idx])))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, [pa.int32()] + [pa.binary()] * 5, strict=True)], ["shard", "doc", "first", "n", "search", "text"])

    return wanted.mapInArrow(tidy(run), "shard int, doc binary, first binary, n binary, search binary, text binary")


def _search(segments: DataFrame, tasks: int, window: int) -> DataFrame:
    """(doc, first, search, mask): bit i set if the run's window i occurs again. One FM-index per shard, one shard at a time in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int32, np.int8, np.int8, np.uint8)

        def shards() -> Iterator[list[np.ndarray]]:
            held: list[list[np.ndarray]] = []
            current = None
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = batch.column(0)[i].as_py()
                    if shard != current and held:
                        yield [np.concatenate(x) for x in zip(*held, strict=True)]
                        held.clear()
                    current = shard
                    held.append([np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns[1:], kinds, strict=True)])
            if held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]

        for doc, first, n, search, data in shards():
            size = n.astype(np.int64) + window - 1
            start = np.cumsum(size + 1) - size  # a separator before each segment
            s, e, _ = word_spans(data, np.array([0, len(data)]))
            _, symbol, _ = distinct(data, s, e)
            text = np.zeros(int((size + 1).sum()) + 1, np.int64)
            old = np.concatenate([[0], np.cumsum(size)[:-1]])
            text[np.repeat(start - old, size) + np.arange(len(symbol))] = symbol + 1
            index = FMIndex(text)
            own = np.flatnonzero(search)
            seg, lo, hi = repeated_windows(index, text, start[own], size[own], window)
            mask = np.zeros(len(own), np.uint64)
            np.bitwise_or.at(mask, seg, ((U64(1) << hi.astype(U64)) - U64(1)) & ~((U64(1) << lo.astype(U64)) - U64(1)))
            hit = mask > 0
            yield pa.RecordBatch.from_arrays([pa.array(doc[own][hit]), pa.array(first[own][hit]), pa.array(search[own][hit]), pa.array(mask[hit].view(np.int64))], ["doc", "first", "search", "mask"])

    return segments.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(tidy(run), "doc long, first int, search byte, mask long")


def _apply(joined: DataFrame, window: int, id_col: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, kept_text = [], [], [], []
            for value, masks in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                parts = (value.as_py() or b"").split()
                total = len(parts)
                if masks.is_valid and total:
                    flat = masks.values
                    edge = np.zeros(total + 1, np.int64)
                    for f, m in zip(flat.field(0).to_numpy(zero_copy_only=False).tolist(), flat.field(1).to_numpy(zero_copy_only=False).tolist(), strict=True):
                        i = f
                        while m:
                            if m & 1:
                                edge[i] += 1
                                edge[i + window] -= 1
                            m >>= 1
                            i += 1
                    keep = np.cumsum(edge[:-1]) == 0
                    parts = [p for p, k in zip(parts, keep.tolist(), strict=True) if k]
                n_words.append(total)
                n_removed.append(total - len(parts))
                kept = b" ".join(parts)
                kept_text.append(kept.decode())
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return joined.mapInArrow(tidy(run), f"{id_col} {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).

    Windows are judged on the input, so every copy of a repeated passage goes,
    in one document too. Null and empty texts have no words; texts shorter than
    a window lose nothing. Ids are integers; repeated rows are documents like
    others (so they lose all windows), and so are rows without an id. Other
    columns are ignored, whatever their names. Empty input: no rows.
    """
    scratch = Scratch(spark, "repeats")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = keyed(scratch, docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), "id_", "doc")
    texts = narrow.select("doc", "text_")
    names, types = ["doc", "first", "n", "side"], ["long", "int", "byte", "byte"]
    found = scratch.table(repeated(_find_runs(texts, 4 * tasks, window), names, types, tasks, 4 * tasks))
    scratch.free_shuffles()
    # Both rows of a run meet; the fingerprint's key tells which runs are alike.
    state = found.groupBy("doc", "first").agg(F.max("n").alias("n"), F.max(F.when(F.col("side") == 0, F.col("key"))).alias("anchor"), F.max(F.when(F.col("side") == 1, F.col("key"))).alias("print"))
    state = scratch.table(state)
    scratch.drop(found)
    alike = ["print", "anchor"]
    place = F.struct("doc", "first", "n")
    two = scratch.table(state.where("print is not null").groupBy(*alike).agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("c")))
    search = lambda kind: F.lit(kind).cast("byte").alias("search")
    wanted = state.where("print is null").select("doc", "first", "n", search(1), "anchor")
    wanted = wanted.unionByName(two.select("lo.*", search(2), "anchor")).unionByName(two.select("hi.*", search(0), "anchor"))
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("first", "n", "search", "anchor")).alias("runs"))
    segments = _segments(texts.join(lists, "doc").select("doc", "text_", "runs"), 4 * tasks, window)
    masks = scratch.table(_search(segments, tasks, window))
    scratch.free_shuffles()
    # What the index says of one run holds for all that are alike.
    told = two.select(*alike, F.col("lo.doc").alias("doc"), F.col("lo.first").alias("first"), "c").join(masks.where("search = 2"), ["doc", "first"]).select(*alike, "mask", "c")
    whole = state.where("print is not null").select("doc", "first", *alike)
    spread = split_join(whole, told, alike, "c", whole.count()).where("mask is not null").select("doc", "first", "mask")
    per_doc = masks.where("search = 1").select("doc", "first", "mask").unionByName(spread).groupBy("doc").agg(F.collect_list(F.struct("first", "mask")).alias("masks"))
    per_doc = scratch.table(per_doc)
    scratch.drop(state, two, masks)
    scratch.free_shuffles()
    return _apply(narrow.join(per_doc, "doc", "left").select("id_", "text_", "masks"), window, id_col, dict(narrow.dtypes)["id_"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
