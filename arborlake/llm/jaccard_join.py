"""Exact near-duplicate components by a parity-sketch join on word shingles.

A document is the set of its 5-word shingles (64-bit hashes), and equal sets are
one node. The hash range is cut into m parts, and a part's sketch is the XOR of
the shingles in it: a shingle that only one of two sets has changes the parity
of exactly one part, so the number of differing parts is a lower bound of the
symmetric difference. Similarity of 3/4 bounds that difference by (|A|+|B|)/7,
so with more parts than that, pigeonhole leaves equal, non-empty parts: two
similar sets share at least u - T of their u non-empty part sketches. Sizes are
banded, each band with its own m; a node is sketched for its own band (side 0)
and for the band below (side 1), and a pair of sketches needs a side 0.

1. Sketches travel to their owners in packed blocks; the repeated ones go on to
   their node's home, which keeps nodes with u - T repeated sketches or more.
2. Of these, nodes with too many shingles that no other has can have no partner:
   such shingles lie in every symmetric difference.
3. Leader rounds over each node's few smallest sketches link most of what
   belongs together, with an exact check of each link; components are contracted
   after each round.
4. All sketches that still span several components are joined, pairs across
   components alone, by the rarest sketches that pigeonhole needs; a bit-parity
   sketch and the sizes prune pairs before they become rows, and the rest are
   checked exactly. So no link between two components is missed, and a group of
   copies costs rows in proportion to its size.

Equality of sets is decided by the size and two 64-bit digests over independent
hashes of the words, which 2^-128 of unequal pairs pass. A link between different
sets is decided on the words of both texts, byte by byte (`_verify`).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, lowered, mix, ngrams, span_hashes, tidy, utf8_chunks, word_spans
from ._owners import BLOCK, owner_groups, send, to_batch, to_owners, wire_schema
from ._scratch import Scratch
from ._spread import split_join
from ._verify import similar_pairs

#: ROUNDS leader rounds over each node's SAMPLE smallest sketches; BITS of the parity sketch that pairs are checked by.
SHINGLE, PERCENT, BITS, ROUNDS, SAMPLE = 5, 75, 1024, 4, 12
#: Rows of a key that one task compares with each other; larger groups are dealt into cells.
CELL = 8192
#: Sets that a task remembers having sketched already.
SEEN = 200_000


def edges_of_bands(top: int = 200) -> np.ndarray:
    """Smallest size of each band; a partner of 3/4 similarity is in the same or the next one."""
    return np.array(sorted({math.ceil((4 / 3) ** j - 1e-9) for j in range(top) if (4 / 3) ** j < 1 << 40}), np.int64)


LOW = edges_of_bands()


def parts_of(scheme: np.ndarray, spread: float) -> np.ndarray:
    """Parts of a scheme, which serves the sizes from LOW[scheme] to below LOW[scheme + 2]."""
    high = LOW[np.minimum(scheme + 2, len(LOW) - 1)].astype(float)
    return np.where(high <= 64, 1 << 16, np.ceil(spread * (0.36 + 2.5 / np.sqrt(high)) * high)).astype(np.int64)


def tolerance(n: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    """Largest symmetric difference to any partner in the scheme."""
    high = LOW[np.minimum(scheme + 2, len(LOW) - 1)] - 1
    return (n + np.minimum(4 * n // 3, high)) // 7


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, second hash) of each distinct shingle, sorted by text and hash."""
    low = lowered(data)
    b, e, t = word_spans(low, offs)
    size = np.bincount(t, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    short = [(z, np.flatnonzero(size == z)) for z in range(1, k)]
    lanes = []
    for lane in (2 * seed, 2 * seed + 1):
        h = span_hashes(low, b, e, lane)
        s = ngrams(h, k, k)
        own = t[: len(s)] == t[k - 1 :] if len(s) else np.zeros(0, bool)
        lanes.append(np.concatenate([s[own], *(ngrams(h, z, 1000 + z)[first[d]] for z, d in short if len(d))]))
    t = np.concatenate([t[: len(s)][own], *(d for _, d in short if len(d))])
    s, second = lanes
    order = np.argsort(s)
    key = t[order].astype(np.uint16) if len(offs) < 1 << 16 else t[order]
    order = order[np.argsort(key, kind="stable")]
    s, t = s[order], t[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return s[keep], t[keep], second[order][keep]


def part_sketches(s: np.ndarray, t: np.ndarray, n: np.ndarray, side: int, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sketch key, text, non-empty parts per text) in the own band's scheme (side 0) or the one below (side 1)."""
    scheme = np.maximum(np.searchsorted(LOW, n, "right") - 1 - side, -1)
    m = np.where(scheme >= 0, parts_of(np.maximum(scheme, 0), spread), 1)
    used = (scheme >= 0)[t]
    s, t = s[used], t[used]
    part = ((s >> U64(32)) * m[t].astype(U64)) >> U64(32)
    first = np.ones(len(s), bool)
    first[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    parity = np.bitwise_xor.reduceat(s, starts)
    t0 = t[starts]
    key = mix(mix(parity) ^ mix(part[starts] * U64(4096) + scheme[t0].astype(U64)))
    return key, t0, np.bincount(t0, minlength=len(n))


def fingerprints(s: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, check) of each text's set: digests of its two hashes that do not depend on the order."""
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    has = np.flatnonzero(n)
    node, check = np.zeros(len(n), U64), np.zeros(len(n), U64)
    if len(has):
        check[has] = np.add.reduceat(mix(second), start[has])
        node[has] = mix(np.add.reduceat(mix(s), start[has]) + n[has].astype(U64) * U64(0x5851F42D4C957F2D))
    return node, check


class _Sender:
    """Gathers the keys of a task's sets into packed blocks for the owners of the keys.

    A set is known by its place in the task (`rid`), which travels as two bytes a
    key: its place in the block and the side.
    """

    def __init__(self, owners: int):
        self.owners, self.next = owners, TaskContext.get().partitionId() << 40
        self.base, self.rows, self.held = self.next, 0, ([], [])

    def add(self, key: np.ndarray, owner: np.ndarray, side: np.ndarray, sets: int) -> Iterator[pa.RecordBatch]:
        """Rows (key, owner, side) of the next sets 0 to sets - 1, sorted by owner."""
        for lo in range(0, sets, 1 << 13):
            hi = min(sets, lo + (1 << 13))
            part = slice(*np.searchsorted(owner, [lo, hi]))
            if self.rows + part.stop - part.start > BLOCK or self.next + hi - lo - self.base > 1 << 15:
                yield from self.flush()
            code = (self.next - self.base + owner[part] - lo) * 2 + side[part]
            self.held[0].append(key[part])
            self.held[1].append(code.astype(np.uint16))
            self.next += hi - lo
            self.rows += part.stop - part.start

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            key, code = (np.concatenate(x) for x in self.held)
            rows = send(key, code >> 1, [code], self.owners, int(key[0] % U64(self.owners)), short=True, useful=code & 1 == 0)
            yield to_batch([(*r, np.int64(self.base).tobytes()) for r in rows], ["code", "base"])
        for x in self.held:
            x.clear()
        self.base, self.rows = self.next, 0


_WIRE = wire_schema(["code", "base"])


def _decode(raw: list[pa.Buffer]) -> list[np.ndarray]:
    """(rid, side) of a block's keys."""
    code = np.frombuffer(raw[0], np.uint16).astype(np.int64)
    return [np.frombuffer(raw[1], np.int64)[0] + (code >> 1), (code & 1).astype(np.int8)]


def _table(kind: int, salt: int, *cols: np.ndarray) -> tuple:
    """A block of kind 8 or 9, which passes the owners: int64 columns side by side."""
    return salt, kind, np.stack([np.asarray(c).astype(np.int64) for c in cols], axis=1).tobytes(), b"", b"", b""


def _sketched(docs: DataFrame, owners: int, spread: float, seed: int) -> DataFrame:
    """Packed sketches of the sets (kind 0 to 2), their needs (8) and one row (9) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = _Sender(owners), set()
        for batch in batches:
            ids = batch.column(0)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offs in utf8_chunks(batch.column(1)):
                s, t, second = shingles(data, offs, seed=seed)
                n = np.bincount(t, minlength=b - a)
                node, check = fingerprints(s, second, n)
                # A set is sketched once a task (twice, should `seen` overflow).
                fresh = np.zeros(b - a, bool)
                if len(seen) > SEEN:
                    seen.clear()
                for i, x in enumerate(node.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                place = np.cumsum(fresh) - 1
                mine = fresh[t]
                s, t, size = s[mine], place[t[mine]], n[fresh]
                parts = [part_sketches(s, t, size, side, spread) for side in (0, 1)]
                key, owner = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                side = np.repeat([0, 1], [len(p[0]) for p in parts])
                order = np.argsort(owner, kind="stable")
                salt = int(node[0] % U64(owners))
                rid = out.next + np.arange(len(size))
                band = np.searchsorted(LOW, size, "right") - 1
                need = [parts[z][2] - tolerance(size, np.maximum(band - z, 0)) for z in (0, 1)]
                need[1] = np.where(parts[1][2] > 0, need[1], 1)
                yield to_batch([_table(9, salt, ids[a:b], valid[a:b], node.view(np.int64), n, check.view(np.int64)), _table(8, salt, rid, node[fresh].view(np.int64), size, *need)], ["code", "base"])
                yield from out.add(key[order], owner[order], side[order], len(size))
        yield from out.flush()

    return docs.mapInArrow(tidy(run), _WIRE)


def _row_keys(rows: DataFrame, owners: int) -> DataFrame:
    """Packed keys of rows (node, n, side, need, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(owners)
        for batch in batches:
            node, n, side, need = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            for a in range(0, len(node), 256):
                part = slice(a, a + 256)
                lists = batch.column(4).slice(a, 256)
                key = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                rid = out.next + np.arange(len(lists))
                needs = [np.where(side[part] == z, need[part], 1) for z in (0, 1)]
                yield to_batch([_table(8, int(key[0] % U64(owners)), rid, node[part], n[part], *needs)], ["code", "base"])
                yield from out.add(key, owner, side[part][owner], len(lists))
        yield from out.flush()

    return rows.select("node", "n", "side", "need", "keys").mapInArrow(tidy(run), _WIRE)


def _homeward(wire: DataFrame, owners: int, homes: int, tasks: int, unique: bool) -> DataFrame:
    """Packed rows on their way to their sets' homes: of keys that several sets have, or (unique) that one alone has."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        info: list[np.ndarray] = []
        rows = 0

        def pack(kind: int, rid: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
            home = (mix(rid.view(np.uint64)) % U64(homes)).astype(np.int64)
            order = np.lexsort((rid, home))
            cuts = np.flatnonzero(np.diff(home[order])) + 1
            return batch_of([(int(home[p[0]]), kind, *(c[p].tobytes() for c in cols), *[b""] * (3 - len(cols))) for p in np.split(order, cuts) if len(p)])

        def batch_of(blobs: list[tuple]) -> pa.RecordBatch:
            each = zip(*blobs, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(each, [pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)], ["home", "kind", "key", "rid", "side"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                key, rid, side = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                rows = 0
                yield pack(0, rid, [rid] if unique else [key, rid, side])

        for what, key, *more in owner_groups(batches, _decode, True, owners):
            if what == "pass":
                # Needs go to the set's home; rows of documents anywhere.
                if key == 8:
                    info.append(np.frombuffer(more[0], np.int64).reshape(-1, 5))
                elif more[0]:
                    yield batch_of([(zlib.crc32(more[0]) % homes, 9, more[0], b"", b"")])
                continue
            if what == "sure":
                if unique:
                    continue
                kept = (key, *more[0])
            else:
                flag, _, (rid, side) = more
                order = np.argsort(key, kind="stable")
                k, r, sd = key[order], rid[order], side[order]
                first = np.concatenate([[True], k[1:] != k[:-1]])
                starts = np.flatnonzero(first)
                two = np.minimum.reduceat(r, starts) != np.maximum.reduceat(r, starts)
                many = (two & np.logical_or.reduceat(sd == 0, starts)) | np.logical_or.reduceat(flag[order], starts)
                keep = (~(many | two) if unique else many)[np.cumsum(first) - 1]
                kept = (k[keep], r[keep], sd[keep])
            held.append(kept)
            rows += len(kept[0])
            if rows >= BLOCK:
                yield from flush()
        yield from flush()
        if info:
            table = np.concatenate(info)
            if len(table):
                yield pack(8, np.ascontiguousarray(table[:, 0]), [table])

    return to_owners(wire, tasks).mapInArrow(tidy(own), "home int, kind int, key binary, rid binary, side binary")


def _by_home(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The blocks (kind, columns) of one home at a time."""
    held: list[tuple[int, list[bytes]]] = []
    current = None
    for batch in batches:
        for i in range(batch.num_rows):
            home = batch.column(0)[i].as_py()
            if home != current and held:
                yield held
                held = []
            current = home
            held.append((batch.column(1)[i].as_py(), [c[i].as_buffer().to_pybytes() for c in batch.columns[2:]]))
    if held:
        yield held


def _to_homes(packed: DataFrame, tasks: int) -> DataFrame:
    return packed.repartition(tasks, "home").sortWithinPartitions("home")


def _candidates(packed: DataFrame, tasks: int) -> DataFrame:
    """Rows (side -1: id, node, n, extra = check) per document, (side 0 or 1: rid, node, n, extra = need, keys) per set that may have a partner, (side -2) where the parts were too few."""
    names = ["id", "rid", "node", "side", "n", "extra", "keys"]

    def batch_of(ids, rid, node, side, n, extra, keys, sizes) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        cols = [ids, pa.array(rid), pa.array(node), pa.array(side.astype(np.int8)), pa.array(n), pa.array(extra), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, U64)
        for blocks in _by_home(batches):
            for _, (raw, *_) in (b for b in blocks if b[0] == 9):
                m = np.frombuffer(raw, np.int64).reshape(-1, 5)
                ids = pa.array(m[:, 0], mask=m[:, 1] == 0)
                zero = np.zeros(len(m), np.int64)
                yield batch_of(ids, zero, np.ascontiguousarray(m[:, 2]), zero - 1, np.ascontiguousarray(m[:, 3]), np.ascontiguousarray(m[:, 4]), none, zero)
            info = [np.frombuffer(b[1][0], np.int64).reshape(-1, 5) for b in blocks if b[0] == 8]
            if not info:
                continue
            info = np.concatenate(info)
            info = info[np.argsort(info[:, 0])]
            known, node, n, need = info[:, 0], info[:, 1], info[:, 2], info[:, 3:].T
            if (need <= 0).any():
                one = np.zeros(1, np.int64)
                yield batch_of(pa.array([None], pa.int64()), one, one, one - 2, one, one, none, one)
            sent = [b[1] for b in blocks if b[0] == 0]
            if not sent:
                continue
            key, rid = (np.concatenate([np.frombuffer(x[i], ty) for x in sent]) for i, ty in ((0, np.uint64), (1, np.int64)))
            side = np.concatenate([np.frombuffer(x[2], np.int8) for x in sent])
            spot = np.searchsorted(known, rid) * 2 + side
            order = np.lexsort((key, spot))
            key, spot = key[order], spot[order]
            k = np.bincount(spot, minlength=2 * len(known))
            enough = k >= np.maximum(need, 1).T.ravel()
            k = k * enough
            key = key[enough[spot]]
            has = np.flatnonzero(k)
            ids = pa.nulls(len(has), pa.int64())
            yield batch_of(ids, known[has // 2], node[has // 2], has % 2, n[has // 2], need.T.ravel()[has], key, k[has])

    return _to_homes(packed, tasks).mapInArrow(tidy(run), "id long, rid long, node long, side byte, n long, extra long, keys array<long>")


def _counts(packed: DataFrame, tasks: int) -> DataFrame:
    """(node, s): rows that reached the set's home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _by_home(batches):
            info = [np.frombuffer(x[0], np.int64).reshape(-1, 5) for kind, x in blocks if kind == 8]
            sent = [np.frombuffer(x[0], np.int64) for kind, x in blocks if kind == 0]
            if info and sent:
                table = np.concatenate(info)
                table = table[np.argsort(table[:, 0])]
                s = np.bincount(np.searchsorted(table[:, 0], np.concatenate(sent)), minlength=len(table))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, 1])), pa.array(s.astype(np.int64))], ["node", "s"])

    return _to_homes(packed, tasks).mapInArrow(tidy(run), "node long, s long")


def _sets(docs: DataFrame, seed: int) -> DataFrame:
    """(node, n, bits, hashes, text): the shingle set, its bit-parity sketch and a text that has it. Wordless texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in utf8_chunks(batch.column(0)):
                s, t, second = shingles(data, offs, seed=seed)
                n = np.bincount(t, minlength=b - a)
                node, _ = fingerprints(s, second, n)
                has = np.flatnonzero(n)
                end = np.cumsum(n)
                bits = []
                for lo, hi in zip((end - n)[has].tolist(), end[has].tolist(), strict=True):
                    odd = np.bincount((mix(s[lo:hi]) & U64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                    bits.append(np.packbits(odd.astype(bool)).tobytes())
                offsets = pa.array(np.concatenate([[0], end[has]]).astype(np.int32))
                text = batch.column(0).slice(a, b - a).take(pa.array(has))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[has].view(np.int64)), pa.array(n[has].astype(np.int64)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(s.view(np.int64))), text],
                    ["node", "n", "bits", "hashes", "text"],
                )

    return docs.mapInArrow(tidy(run), "node long, n long, bits binary, hashes array<long>, text string")


def _linked(scratch: Scratch, pairs: DataFrame, sets: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame | None:
    """The pairs (a, b), a table, whose texts are similar; None if there are none. Texts meet pairs by shuffles, a text with many pairs in several places."""
    rows = pairs.count()
    if not rows:
        return None
    salts = F.lit(1 + rows // 20_000)
    out = pairs
    for end, other in (("a", "b"), ("b", "a")):
        salt = F.pmod(F.xxhash64(other), salts).alias("salt")
        one = sets.select(F.col("node").alias(end), F.col("text").alias(f"t{end}")).join(pairs.select(end, salt).distinct(), end)
        out = out.withColumn("salt", salt).join(one, [end, "salt"]).drop("salt")
    found = scratch.table(similar_pairs(out, k, percent))
    return found if found.limit(1).count() else None


def _contracted(scratch: Scratch, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the components that links (a, b) join merged: their least label."""
    comp = nodes.select("node", "comp")
    ends = links.join(comp.withColumnsRenamed({"node": "a", "comp": "x"}), "a").join(comp.withColumnsRenamed({"node": "b", "comp": "y"}), "b").where("x <> y").select("x", "y")
    both = scratch.table(ends.union(ends.select("y", "x")).distinct())
    label = scratch.table(both.groupBy(F.col("x").alias("doc")).agg(F.least(F.min("y"), F.first("x")).alias("comp")))
    while True:
        after = scratch.table(_step(both, label).join(label.withColumnRenamed("comp", "old"), "doc"))
        moved = after.where("comp < old").limit(1).count()
        label = after.select("doc", "comp")
        if not moved:
            break
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size_"))
    one = label.withColumnsRenamed({"comp": "new_", "doc": "comp"}).join(sizes, "comp")
    moved = split_join(nodes, one, ["comp"], "size_", nodes.count()).withColumn("comp", F.coalesce("new_", "comp")).drop("new_", "size_")
    return scratch.table(moved.select(*nodes.columns))


def _step(both: DataFrame, label: DataFrame) -> DataFrame:
    """The least label among a doc and its neighbours, then that label's own label."""
    low = both.join(label, both.x == label.doc).groupBy(F.col("y").alias("doc")).agg(F.min("comp").alias("m"))
    best = label.join(low, "doc").select("doc", F.least("comp", "m").alias("new"))
    far = label.select(F.col("doc").alias("new"), F.col("comp").alias("far"))
    return best.join(far, "new", "left").select("doc", F.least("new", F.coalesce("far", "new")).alias("comp"))


def _led(scratch: Scratch, sample: DataFrame, nodes: DataFrame, rows: int, turn: int) -> DataFrame:
    """(a, b): each node with the leader in another component that most of its sampled sketches name; a sketch's leader has few shingles of its own."""
    table = sample.join(nodes.select("node", "comp", "n", "w"), "node")
    order = F.struct(F.floor(8 * F.col("w") / F.col("n")), F.xxhash64("node", F.lit(turn)))
    lead = F.min_by(F.struct("node", "n", "comp", "w"), order).alias("lead")
    groups = table.groupBy("key").agg(lead, F.min("comp").alias("lo_"), F.max("comp").alias("hi_"), F.count("*").alias("c")).where("lo_ < hi_").drop("lo_", "hi_")
    led = split_join(table, groups, ["key"], "c", rows).where("lead.comp <> comp and w + lead.w <= 0 and 4 * n >= 3 * lead.n and 4 * lead.n >= 3 * n")
    votes = led.groupBy("node", F.col("lead.node").alias("a")).agg(F.count("*").alias("v"))
    return scratch.table(votes.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("v", "a")).alias("best")).select("best.a", "b"))


def parity_allows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether bit-parity sketches leave room for a link, n being the sum of the two sizes."""
    return 7 * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= n


#: (sketches, sketches, sums of sizes) -> which pairs may be linked.
Allows = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _pairs_across(rows: DataFrame, allows: Allows = parity_allows) -> DataFrame:
    """(a, b) of rows (key, cell, blk, node, comp, side, n, w, bits), grouped: pairs of one key, of different components, that sizes, w and bits allow.

    Only light nodes (w <= 0) are compared with others, for of two similar ones
    one is light; pairs are told once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal held
            ab = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            found.clear()
            found.append(ab)
            held = len(ab)
            if held > 1 << 19:
                found.clear()
                held = 0
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])

        def compare(cols: list[np.ndarray], bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            nonlocal held
            _, _, blk, node, _, _, n, _ = cols
            for a in range(0, len(x), 1 << 17):
                i, j = x[a : a + (1 << 17)], y[a : a + (1 << 17)]
                ok = allows(bits[i], bits[j], n[i] + n[j])
                i, j = node[i[ok]], node[j[ok]]
                if len(i):
                    found.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0))
                    held += len(found[-1])

        def allowed(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
            _, cell, blk, _, comp, side, n, w = cols
            ok = (comp[i] != comp[j]) & (w[i] + w[j] <= 0) & (4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i]) & (side[i] + side[j] < 2)
            return ok & ((cell[i] == 0) | (blk[i] != blk[j]))

        def groups(cols: list[np.ndarray], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, cell, _, _, comp, _, _, w = cols
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
            size = np.diff(np.append(start, len(key)))
            light = np.logical_or.reduceat(w <= 0, start) & (np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start))
            for z in np.unique(size[light & (size <= 48)]).tolist():
                iu, ju = np.triu_indices(z, 1)
                own = start[light & (size == z)]
                step = max(1, (1 << 18) // max(1, len(iu)))
                for a in range(0, len(own), step):
                    i, j = ((own[a : a + step, None] + q).ravel() for q in (iu, ju))
                    ok = allowed(cols, i, j)
                    compare(cols, bits, i[ok], j[ok])
                    if held > 1 << 20:
                        yield from told()
            for a, z in zip(start[light & (size > 48)].tolist(), size[light & (size > 48)].tolist(), strict=True):
                every = np.arange(a, a + z)
                lead = every[w[a : a + z] <= 0]
                step = max(1, (1 << 18) // z)
                for b in range(0, len(lead), step):
                    i, j = np.repeat(lead[b : b + step], z), np.tile(every, len(lead[b : b + step]))
                    ok = ((w[j] > 0) | (j > i)) & allowed(cols, i, j)
                    compare(cols, bits, i[ok], j[ok])
                    if held > 1 << 20:
                        yield from told()

        rest = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(8)]
            bits = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(len(cols[0]), -1)
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest[0], cols, strict=True)]
                bits = np.concatenate([rest[1], bits])
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield from groups([c[:cut] for c in cols], bits[:cut])
            rest = [c[cut:] for c in cols], bits[cut:]
        if rest is not None and len(rest[0][0]):
            yield from groups(*rest)
        yield from told()
        for ab in found:
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])

    return rows.select("key", "cell", "blk", "node", "comp", "side", "n", "w", "bits").mapInArrow(tidy(run), "a long, b long")


def _open_pairs(scratch: Scratch, table: DataFrame, nodes: DataFrame, sets: DataFrame, tasks: int, cell_rows: int, allows: Allows = parity_allows) -> DataFrame:
    """(a, b): all pairs across components that may be linked. table: (node, side, need, keys)."""
    rows = table.join(nodes.select("node", "comp"), "node").select("node", "side", "need", "comp", F.explode("keys").alias("key"))
    groups = rows.groupBy("key").agg(F.min("comp").alias("lo_"), F.max("comp").alias("hi_"), F.min("side").alias("side_"), F.count("*").alias("c"))
    groups = groups.where("lo_ < hi_ and side_ <= 0").select("key", "c")
    total = table.agg(F.sum(F.size("keys"))).first()[0] or 0
    still = split_join(rows, groups, ["key"], "c", total).where("c is not null")
    per_node = still.groupBy("node", "side").agg(F.max("need").alias("need"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("open"))
    # Two similar nodes share `need` open sketches or more, so the rarest `size - need + 1` of each have one in common.
    per_node = per_node.where(F.size("open") >= F.col("need")).withColumn("open", F.slice("open", 1, F.size("open") - F.greatest("need", F.lit(1)) + 1))
    per_node = scratch.table(per_node.select("node", "side", "open"))
    full = per_node.join(nodes.select("node", "comp", "n", "w"), "node").join(sets.select("node", "bits"), "node")
    each = full.select("node", "side", "comp", "n", "w", "bits", F.explode("open").alias("o")).select("*", F.col("o.key").alias("key"), F.ceil(F.col("o.c") / cell_rows).cast("long").alias("g")).drop("o")
    blk = F.pmod(F.xxhash64("node"), F.col("g"))
    cells = F.when(F.col("g") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda j: F.least("blk", j) * F.col("g") + F.greatest("blk", j)))
    each = each.withColumn("blk", blk).select("*", F.explode(cells).alias("cell"))
    # A cell on the diagonal compares a block with itself, which cell 0 stands for.
    each = each.withColumn("own_", F.col("cell") == F.col("blk") * F.col("g") + F.col("blk"))
    each = each.withColumn("key", F.when(F.col("own_") & (F.col("g") > 1), F.xxhash64("key", "blk")).otherwise(F.col("key"))).withColumn("cell", F.when(F.col("own_"), F.lit(0)).otherwise(F.col("cell"))).drop("own_", "g")
    n_rows = per_node.agg(F.sum(F.size("open"))).first()[0] or 0
    places = max(1, min(tasks, n_rows // 50_000))
    dealt = each.repartition(places, "key", "cell").sortWithinPartitions("key", "cell")
    return scratch.table(_pairs_across(dealt, allows).distinct())


def merged(
    scratch: Scratch, table: DataFrame, nodes: DataFrame, sets: DataFrame, linked: Callable[[DataFrame], DataFrame | None], tasks: int, cell_rows: int, rounds: int, allows: Allows = parity_allows
) -> DataFrame:
    """nodes with their components, by leader rounds and then by all pairs across components that may be linked. linked: the pairs that are, if any."""
    sample = scratch.table(table.select("node", F.explode(F.slice("keys", 1, SAMPLE)).alias("key")).distinct())
    scratch.free_shuffles()
    rows = sample.count()
    for turn in range(rounds if rows else 0):
        links = linked(_led(scratch, sample, nodes, rows, turn))
        if links is None:
            break
        nodes = _contracted(scratch, nodes, links)
        scratch.free_shuffles()
    if rows:
        links = linked(_open_pairs(scratch, table, nodes, sets, tasks, cell_rows, allows))
        if links is not None:
            nodes = _contracted(scratch, nodes, links)
        scratch.free_shuffles()
    return nodes


def named(scratch: Scratch, meta: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n, component_id) of the rows of meta (id, node, n); classes (node, rep, c) are the sets, nodes (node, comp) those that may have partners."""
    in_comp = nodes.select("node", "comp").join(classes.select("node", "rep"), "node")
    least = in_comp.groupBy("comp").agg(F.min("rep").alias("least_"), F.count("*").alias("size_")).where("size_ > 1")
    told = split_join(in_comp, least, ["comp"], "size_", nodes.count()).select("node", F.col("least_"))
    final = scratch.table(classes.select("node", "rep", "c").join(told, "node", "left").select("node", "c", F.coalesce("least_", "rep").alias("component_id")))
    some = split_join(meta.where("n > 0"), final, ["node"], "c", meta.count()).select("id", "n", "component_id")
    return some.unionByName(meta.where("n = 0").select("id", "n", F.col("id").alias("component_id")))


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: float = 1.0, rounds: int = ROUNDS, cell_rows: int = CELL) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links of similarity >= 0.75).

    Ids are integers; repeated ids and rows without an id are rows like others,
    except that a null is never the smallest id. Null and empty texts and such
    without words have no shingles and are linked with nothing: their component
    is their own id. Equal sets are one node and compared once. Other columns are
    ignored, whatever their names. Empty input: no rows. Only counts reach the
    driver. Rows must come in the same order when a lost task is run again, as
    those of files do. The work inside one sketch's group that spans components is a product
    of their rows, dealt into cells of `cell_rows` rows; pairs without a light
    node (see `_pairs_across`) are never looked at.
    """
    scratch = Scratch(spark, "jaccard")
    narrow = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = 4 * tasks
    seed = 0
    while True:
        raw = scratch.table(_candidates(_homeward(_sketched(narrow, owners, spread, seed), owners, tasks, tasks, False), tasks))
        scratch.free_shuffles()
        meta = scratch.table(raw.where("side = -1").select("id", "node", "n", F.col("extra").alias("check")))
        agg = meta.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.max("n").alias("n"), (F.struct(F.min("check"), F.min("n")) < F.struct(F.max("check"), F.max("n"))).alias("clash"))
        classes = scratch.table(agg)
        # All u parts of a set could differ: more parts, then. Or two sets have one digest: other hashes. Both are made all but impossible.
        few, clash = raw.where("side = -2").limit(1).count(), classes.where("clash").limit(1).count()
        if not few and not clash:
            break
        spread, seed = spread * 1.5 if few else spread, seed + 1
        scratch.drop(raw, meta, classes)
    # Tasks that had the same set sent it each, so its sketches seemed to repeat: now one of them stands for the node.
    sent = raw.where("side >= 0").select("rid", "node", "n", "side", F.col("extra").alias("need"), "keys")
    one = sent.groupBy("node").agg(F.min("rid").alias("rid"))
    sent = scratch.table(sent.join(one.select("rid"), "rid", "left_semi"))
    table = scratch.table(_candidates(_homeward(_row_keys(sent, owners), owners, tasks, tasks, False), tasks).select("node", "side", F.col("extra").alias("need"), "keys"))
    scratch.drop(raw, sent)
    scratch.free_shuffles()
    active = scratch.table(table.select("node").distinct().join(classes.select("node", "rep"), "node"))
    wanted = active.where("rep is not null").select(F.col("rep").alias("id_")).distinct()
    nameless = narrow.where("id_ is null") if active.where("rep is null").limit(1).count() else narrow.limit(0)
    texts = narrow.where("id_ is not null").join(wanted, "id_", "left_semi").unionByName(nameless).select("text_")
    sets = scratch.table(_sets(texts, seed).join(active.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    scratch.free_shuffles()
    all_keys = sets.select("node", "n", F.lit(0).alias("side"), F.lit(1).alias("need"), F.col("hashes").alias("keys"))
    alone = _counts(_homeward(_row_keys(all_keys, owners), owners, tasks, tasks, True), tasks)
    own = F.coalesce("s", F.lit(0))
    # Of similar sets A and B, |A - B| is at most |A| / 4, and the symmetric difference at most (|A| + |B|) / 7.
    nodes = sets.select("node", "n").join(alone, "node", "left").where(4 * own <= F.col("n")).select("node", "n", (7 * own - F.col("n")).alias("w"), F.col("node").alias("comp"))
    nodes = scratch.table(nodes)
    every, table = table, scratch.table(table.join(nodes.select("node"), "node", "left_semi"))
    scratch.drop(every)
    nodes = merged(scratch, table, nodes, sets, lambda pairs: _linked(scratch, pairs, sets), tasks, cell_rows, rounds)
    return named(scratch, meta, classes, nodes).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def components_sql(k: int, percent: int) -> str:
    """(doc_id, n_shingles, component_id) in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END
  ) AS g FROM texts
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT s.x, s.y FROM shared s JOIN sizes a ON a.doc_id = s.x JOIN sizes b ON b.doc_id = s.y WHERE 100 * s.n >= {percent} * (a.n + b.n - s.n)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON r.y = e.x)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(t.doc_id, r.least) AS component_id
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x) r USING (doc_id)"""


OP7_SQL = components_sql(SHINGLE, PERCENT)
