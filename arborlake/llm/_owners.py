"""Which 64-bit keys occur more than once: one shuffle of packed blocks.

Map tasks turn documents into (key, payload) columns. A key that a block holds
more than once is known to repeat, so all but one of its rows skip the owner
(`sure` rows); each block sends an owner one row per key at most, so a key that
a third of all documents have costs its owner one row per block. Rows travel as
binary blocks per owner, and owners sort them in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import U64

#: Rows of a map block; a block's arrays are what a Python worker holds.
BLOCK = 400_000


def send(key: np.ndarray, multi_unit: np.ndarray, rest: list[np.ndarray], owners: int, salt: int, short: bool = False, useful: np.ndarray | None = None) -> list[tuple]:
    """Packed rows of one block. multi_unit: what a key must differ in to count as repeated (document, run).

    useful: rows of which a repeated key needs one at least (all, by default).
    short: only 40 bits of a key travel (beside its owner), for uses where a
    false repeat costs work but no result. Within an owner, rows keep the order
    of the documents, so their columns compress.
    """
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    unit = multi_unit[order]
    many = np.minimum.reduceat(unit, starts) != np.maximum.reduceat(unit, starts)
    if useful is not None:
        many &= np.logical_or.reduceat(useful[order], starts)
    many = many[group]
    lead, repeated_ = np.empty(len(key), bool), np.empty(len(key), bool)
    lead[order], repeated_[order] = first, many
    owner = ((key >> U64(40)) % U64(owners)).astype(np.int64)
    # Leads go to their owner; further rows of a repeated key need no owner, and those of one unit follow their lead.
    kind = np.where(lead, 0, np.where(repeated_, 1, 2))
    dest = np.where(kind == 1, salt % owners, owner)
    by = np.argsort(dest * 3 + kind, kind="stable")
    out = []
    for part in np.split(by, np.flatnonzero(np.diff((dest * 3 + kind)[by])) + 1):
        if len(part):
            k = int(kind[part[0]])
            out.append((int(dest[part[0]]), k, _narrow(key[part]) if short and k != 1 else key[part].tobytes(), repeated_[part].tobytes() if k == 0 else b"", *(r[part].tobytes() for r in rest)))
    return out


def _narrow(key: np.ndarray) -> bytes:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(raw: np.ndarray, owner: int) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel() | (U64(owner) << U64(40))


def wire_schema(rest: list[str]) -> str:
    return "owner int, kind int, key binary, flag binary, " + ", ".join(f"{r} binary" for r in rest)


def to_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(4 + len(names))]
    types = [pa.int32(), pa.int32()] + [pa.binary()] * (2 + len(names))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["owner", "kind", "key", "flag", *names])


def owner_groups(batches: Iterator[pa.RecordBatch], decode: Callable[[list[pa.Buffer]], list[np.ndarray]], short: bool, owners: int) -> Iterator[tuple]:
    """What a task gets, whose blocks are sorted by owner: ("pass", kind, bytes), ("sure", key, rest), and per owner, one at a time, ("own", key, flag, follow, rest).

    So a worker holds the blocks of one owner, however many owners its task has.
    decode: a block's further columns as arrays as long as its keys.
    """
    held: list[tuple] = []
    current = None

    def group() -> tuple:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return "own", *cols[:3], cols[3:]

    for batch in batches:
        for i in range(batch.num_rows):
            owner, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            raw = batch.column(2)[i].as_buffer()
            if kind >= 8:
                yield "pass", kind, raw.to_pybytes()
                continue
            rest = decode([c[i].as_buffer() for c in batch.columns[4:]])
            if kind == 1:
                key = np.frombuffer(raw, np.uint64)
                yield "sure", (key & U64((1 << 40) - 1)) | (((key >> U64(40)) % U64(owners)) << U64(40)) if short else key, rest
                continue
            if owner != current and held:
                yield group()
            current = owner
            key = _wide(np.frombuffer(raw, np.uint8), owner) if short else np.frombuffer(raw, np.uint64)
            flag = np.frombuffer(batch.column(3)[i].as_buffer(), bool) if kind == 0 else np.zeros(len(key), bool)
            held.append((key, flag, np.full(len(key), kind == 2), *rest))
    if held:
        yield group()


def to_owners(wire: DataFrame, tasks: int) -> DataFrame:
    return wire.repartition(tasks, "owner").sortWithinPartitions("owner")


def repeated(wire: DataFrame, names: list[str], types: list[str], tasks: int, owners: int, short: bool = False) -> DataFrame:
    """(key long, names...) rows whose key repeats over units."""
    np_types = {"long": np.int64, "int": np.int32, "byte": np.int8}

    def decode(raw: list[pa.Buffer]) -> list[np.ndarray]:
        return [np.frombuffer(r, np_types[t]) for r, t in zip(raw, types, strict=True)]

    def emit(key: np.ndarray, rest: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(key), 1 << 18):
            s = slice(a, a + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), *(pa.array(r[s]) for r in rest)], ["key", *names])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for what, key, *more in owner_groups(batches, decode, short, owners):
            if what == "sure":
                yield from emit(key, more[0])
                continue
            flag, follow, rest = more
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(first)
            leads = np.add.reduceat((~follow[order]).astype(np.int32), starts)
            many = (leads > 1) | np.logical_or.reduceat(flag[order], starts)
            keep = many[np.cumsum(first) - 1]
            yield from emit(key[keep], [r[order][keep] for r in rest])

    schema = "key long, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return to_owners(wire, tasks).mapInArrow(own, schema)
