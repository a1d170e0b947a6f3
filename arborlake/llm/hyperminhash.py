"""Near-duplicate components by HyperMinHash sketches.

A document is the set of its 2-word shingles, and equal sets are one node. The
hash range is cut into BUCKETS; a bucket keeps the least second hash of the
shingles in it, as leading-zero count and MANTISSA bits behind the leading one:
16 bits a register, 0 for an empty bucket. Bands of BAND registers are keys: at
similarity 4/5 a band agrees with probability 1/2 or more, so all bands of a
pair differ about once in 2^40 pairs. Sets of at most TINY shingles also have a
key per shingle, where pigeonhole makes sure of it (a similar set differs in a
quarter of them at most). Shingles that no other set has lie in every symmetric
difference, so sets with too many of them have no partner, and of two that are
similar one has few. A pair that shares a key is compared by its registers: not
more of them may differ than shingles, and the similarity they tell, less the
collisions that compressed registers expect, may not lie SIGMAS standard
deviations below the threshold. Where that leaves room, bit parities of the
shingles do the same without chance. What remains is decided on the words of
both texts.

Nodes become components as in `jaccard_join`: leader rounds first, and then all
keys that still span several components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, mix, tidy, utf8_chunks
from ._scratch import Scratch
from ._spread import keyed, split_join
from .jaccard_join import CELL, ROUNDS, _counts, _homeward, _linked, _row_keys, components_sql, fingerprints, merged, named, shingles

SHINGLE, PERCENT = 2, 80
BUCKETS, BAND, MANTISSA, TINY, SIGMAS = 120, 3, 10, 12, 7
BANDS = BUCKETS // BAND
#: Bits of the parities beside the registers.
PARITY = 2048
#: Lowest bits of registers that may differ. At similarity 4/5 one does with probability 1/10 at most, and more than so many of 120 with less than 2^-40.
ODD = 43
#: Cells of the marks a wanted text, and rows that are compared at once.
MARKS, ROWS = 8, 1 << 16


def registers(s: np.ndarray, t: np.ndarray, texts: int) -> np.ndarray:
    """The sketch of each text, 16 bits a bucket. s, t: hashes and texts of distinct shingles, sorted by text and hash."""
    out = np.zeros((texts, BUCKETS), np.uint16)
    if not len(s):
        return out
    bucket = (((s >> U64(32)) * U64(BUCKETS)) >> U64(32)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])
    start = np.flatnonzero(first)
    least = np.minimum.reduceat(mix(s ^ U64(0x2545F4914F6CDD1D)), start)
    bits = np.frexp(least.astype(float))[1]
    bits -= (bits > 0) & (U64(1) << np.maximum(bits - 1, 0).astype(np.uint64) > least)  # rounded up to a power of two
    zeros = np.minimum(64 - bits, 62)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> U64(64 - MANTISSA)
    out[t[start], bucket[start]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


def band_keys(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of all bands that are not empty."""
    wide = reg.astype(np.uint64).reshape(len(reg), BANDS, BAND)
    packed = np.zeros((len(reg), BANDS), np.uint64)
    for j in range(BAND):
        packed |= wide[:, :, j] << U64(16 * j)
    t, band = np.nonzero(packed)
    return mix(packed[t, band] | (band.astype(np.uint64) + U64(1)) << U64(48)), t


def expected_collisions(n: np.ndarray) -> np.ndarray:
    """Registers of two sets without a common shingle that agree, where both have n / 2 shingles.

    The least hashes of a bucket are exponential, at rate x = shingles a bucket each; both lie in
    one cell of width 2^-(i + MANTISSA) in octave i with the probability that is summed here.
    """
    x = np.maximum(n, 1) / 2 / BUCKETS
    out = np.zeros(len(x))
    for i in range(1, 63):
        out += 2.0 ** (-i - MANTISSA) * x / 2 * (np.exp(-2 * x * 2.0**-i) - np.exp(-2 * x * 2.0 ** (1 - i)))
    return BUCKETS * out


def registers_allow(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether registers leave room for a link, n being the sum of the two sizes."""
    either = np.count_nonzero(a | b, axis=1)
    differ = np.count_nonzero(a != b, axis=1)
    # A shingle that one set alone has changes one register at most.
    ok = (100 + PERCENT) * differ <= (100 - PERCENT) * n
    told = (either - differ - expected_collisions(n)) / np.maximum(either, 1)
    goal = PERCENT / 100
    return ok & (told >= goal - SIGMAS * np.sqrt(goal * (1 - goal) / np.maximum(either, 1)))


def parities(s: np.ndarray, t: np.ndarray, texts: int) -> np.ndarray:
    """A row of bits per text: how many shingles fall on it, modulo 2."""
    odd = np.zeros((texts, PARITY), bool)
    place = (mix(s ^ U64(0x94D049BB133111EB)) & U64(PARITY - 1)).astype(np.int64)
    np.logical_xor.at(odd, (t, place), True)
    return np.packbits(odd, axis=1)


def sketches_allow(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether registers and then parities, side by side in rows of 64-bit numbers, leave room for a link."""
    cut = BUCKETS // 4
    ok = registers_allow(*(np.ascontiguousarray(x[:, :cut]).view(np.uint16).reshape(len(n), BUCKETS) for x in (a, b)), n)
    at = np.flatnonzero(ok)
    differ = np.bitwise_count(a[at, cut:] ^ b[at, cut:]).sum(axis=1, dtype=np.int64)
    ok[at] = (100 + PERCENT) * differ <= (100 - PERCENT) * n[at]
    return ok


def _sketched(docs: DataFrame, seed: int) -> DataFrame:
    """(id, k, node, check, n, bits, tiny) of rows (id, text, k); tiny: the shingles of a set of TINY at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in utf8_chunks(batch.column(1)):
                s, t, second = shingles(data, offs, SHINGLE, seed)
                n = np.bincount(t, minlength=b - a)
                node, check = fingerprints(s, second, n)
                reg = registers(s, t, b - a)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BUCKETS), b - a, [None, pa.py_buffer(reg.tobytes())]).cast(pa.binary())
                small = n <= TINY
                ends = np.cumsum(np.where(small, n, 0))
                tiny = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(s[small[t]].view(np.int64)))
                cols = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(n.astype(np.int64)), raw, tiny]
                yield pa.RecordBatch.from_arrays(cols, ["id", "k", "node", "check", "n", "bits", "tiny"])

    return docs.mapInArrow(tidy(run), "id long, k long, node long, check long, n long, bits binary, tiny array<long>")


def _sets(texts: DataFrame, seed: int) -> DataFrame:
    """(node, n, bits, text) of rows (text): registers and parities, and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in utf8_chunks(batch.column(0)):
                s, t, second = shingles(data, offs, SHINGLE, seed)
                n = np.bincount(t, minlength=b - a)
                node, _ = fingerprints(s, second, n)
                rows = np.concatenate([registers(s, t, b - a).view(np.uint8), parities(s, t, b - a)], axis=1)
                cols = [pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(0).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(cols, ["node", "n", "bits", "text"])

    return texts.mapInArrow(tidy(run), "node long, n long, bits binary, text string")


def _shingle_rows(sets: DataFrame, seed: int) -> DataFrame:
    """(node, n, side, need, keys) of rows (node, n, text): the shingles, made from the text again, as they are longer than it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in utf8_chunks(batch.column(2)):
                s, t, _ = shingles(data, offs, SHINGLE, seed)
                ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=b - a))])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.view(np.int64)))
                zero = np.zeros(b - a, np.int32)
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(zero), pa.array(zero + 1), keys]
                yield pa.RecordBatch.from_arrays(cols, ["node", "n", "side", "need", "keys"])

    return sets.select("node", "n", "text").mapInArrow(tidy(run), "node long, n long, side int, need int, keys array<long>")


def _keys(classes: DataFrame) -> DataFrame:
    """(node, side, need, key) of rows (node, n, bits, tiny): the bands (side 0), and each shingle of small sets (side -1). A partner shares `need` of them or more."""

    def table(node: np.ndarray, t: np.ndarray, side: int, need: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(node[t]), pa.array(np.full(len(t), side, np.int8)), pa.array(need[t]), pa.array(key.view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["node", "side", "need", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (batch.column(i).to_numpy() for i in (0, 1))
            other = n * (100 - PERCENT) // PERCENT
            reg = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            key, t = band_keys(reg)
            yield table(node, t, 0, np.maximum(np.bincount(t, minlength=len(node)) - other, 1), key)
            tiny = batch.column(3)
            key = mix(tiny.flatten().to_numpy().view(np.uint64) ^ U64(0x9FB21C651E98DF25))
            yield table(node, np.repeat(np.arange(len(node)), tiny.value_lengths().to_numpy()), -1, n - other, key)

    return classes.select("node", "n", "bits", "tiny").mapInArrow(tidy(run), "node long, side byte, need long, key long")


def _signed(classes: DataFrame) -> DataFrame:
    """(node, n, s0, s1) of rows (node, n, bits): the lowest bit of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reg = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            low = np.zeros((len(reg), 128), np.uint8)
            low[:, :BUCKETS] = reg & 1
            sign = np.packbits(low, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.ascontiguousarray(sign[:, i])) for i in (0, 1))], ["node", "n", "s0", "s1"])

    return classes.select("node", "n", "bits").mapInArrow(tidy(run), "node long, n long, s0 long, s1 long")


def partnered(key: np.ndarray, n: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Which rows have another of their key that size and lowest bits allow. Rows are sorted by key and size; sign: two 64-bit numbers a row."""
    found, sign = np.zeros(len(key), bool), sign.view(np.uint64)  # bits of a signed number would be counted in its absolute value
    i, step = np.arange(len(key)), 0
    while len(i):
        step += 1
        i = i[i + step < len(key)]
        i = i[(key[i] == key[i + step]) & (PERCENT * n[i + step] <= 100 * n[i])]
        a = i[~(found[i] & found[i + step])]
        b = a + step
        differ = np.bitwise_count(sign[a] ^ sign[b]).sum(axis=1, dtype=np.int64)
        # A shingle that one set alone has changes one register at most.
        ok = (differ <= ODD) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (n[a] + n[b]))
        found[a[ok]] = True
        found[b[ok]] = True
    return found


def _partnered(rows: DataFrame, cell_rows: int) -> DataFrame:
    """The rows (node, side, need, key) of rows (node, side, need, key, c, n, s0, s1), c being the rows of the key, that have a partner by `partnered`.

    Keys of more than cell_rows rows are dealt out and pass as they are: what
    comes after compares all that is left.
    """
    large = F.col("c") > cell_rows
    cell = F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / cell_rows))).otherwise(F.lit(0).cast("long"))
    dealt = rows.select("node", "side", "need", "key", "n", "s0", "s1", large.alias("large"), cell.alias("cell"))
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "n").drop("cell")

    def kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, n, large = (table[c].to_numpy() for c in ("key", "n", "large"))
        sign = np.stack([table[c].to_numpy() for c in ("s0", "s1")], axis=1)
        keep = large.copy()
        small = np.flatnonzero(~large)
        keep[small] = partnered(key[small], n[small], sign[small])
        yield from table.select(["node", "side", "need", "key"]).filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            start = int(np.searchsorted(key, key[-1]))
            # A key that is compared whole has cell_rows rows at most; more are held only of a key that passes.
            cut = start if not table["large"][-1].as_py() else rows
            yield from kept(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield from kept(pa.Table.from_batches(held))

    return dealt.mapInArrow(tidy(run), "node long, side byte, need long, key long")


def _likely(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key may be one of wanted's: those of a marked cell, MARKS cells a wanted key, as one bit each. An exact join comes after; other texts need no shuffle."""
    cells = 64 * -(-MARKS * max(1, wanted.count()) // 64)
    cell = F.pmod(F.xxhash64(key), F.lit(cells))
    word, bit = F.shiftright(cell, 6), (cell % 64).cast("int")
    marks = wanted.groupBy(word.alias("word_")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("marks_"))
    return docs.withColumn("word_", word).join(F.broadcast(marks), "word_").where(F.bit_get("marks_", bit) == 1).select(*docs.columns)


def near_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, cell_rows: int = CELL) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links of similarity >= 0.8), kept.

    Ids are integers; repeated ids and rows without an id are rows like others,
    except that a null is never the smallest id. Kept are the rows whose id is the
    component's: all of them where ids repeat, and rows without an id where no row
    of the component has one. Null and empty texts and such without words have no
    shingles, are linked with nothing and kept. A text of one word is one shingle.
    Equal sets are one node and compared once; texts of any length are read whole.
    Other columns are ignored, whatever their names. Empty input: no rows. Only
    counts reach the driver.
    """
    scratch = Scratch(spark, "hyperminhash")
    # A row's key of its own tells which text stands for a set, so no set is sent twice and none needs to meet its copies.
    narrow = keyed(scratch, docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_")), "id_", "k_")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seed = 0
    while True:
        meta = scratch.table(_sketched(narrow, seed))
        by_node = meta.where("n > 0").groupBy("node")
        clash = (F.struct(F.min("check"), F.min("n")) < F.struct(F.max("check"), F.max("n"))).alias("clash")
        classes = scratch.table(by_node.agg(F.min("id").alias("rep"), F.min("k").alias("k"), F.count("*").alias("c"), F.max("n").alias("n"), F.min("bits").alias("bits"), F.min("tiny").alias("tiny"), clash))
        if not classes.where("clash").limit(1).count():
            break
        # Two sets have one digest: other hashes.
        seed += 1
        scratch.drop(meta, classes)
    # From here on, registers are read from the sets alone.
    whole, meta = meta, scratch.table(meta.select("id", "node", "n"))
    scratch.drop(whole)
    every = scratch.table(_keys(classes))
    scratch.free_shuffles()
    groups = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    again = scratch.table(split_join(every, groups, ["key"], "c", every.count()).where("c is not null"))
    scratch.drop(every)
    scratch.free_shuffles()
    own = _partnered(again.join(_signed(classes), "node"), cell_rows).groupBy("node", "side").agg(F.max("need").alias("need"), F.sort_array(F.collect_list("key")).alias("keys"))
    table = scratch.table(own.where(F.size("keys") >= F.col("need")))
    scratch.drop(again)
    scratch.free_shuffles()
    wanted = scratch.table(table.select("node").distinct().join(classes.select("node", F.col("k").alias("k_")), "node").select("k_"))
    sets = scratch.table(_sets(_likely(narrow, wanted, "k_").join(wanted, "k_", "left_semi").select("text_"), seed))
    scratch.free_shuffles()
    owners = 4 * tasks
    alone = _counts(_homeward(_row_keys(_shingle_rows(sets, seed), owners), owners, tasks, tasks, True), tasks)
    own = F.coalesce("s", F.lit(0))
    # Of similar sets A and B, |A - B| is at most a fifth of |A|, and the symmetric difference at most (|A| + |B|) / 9.
    few = sets.select("node", "n").join(alone, "node", "left").where(100 * own <= (100 - PERCENT) * F.col("n"))
    weight = ((100 + PERCENT) * own - (100 - PERCENT) * F.col("n")).alias("w")
    nodes = scratch.table(few.select("node", "n", weight, F.col("node").alias("comp")))
    table = scratch.table(table.join(nodes.select("node"), "node", "left_semi"))
    scratch.free_shuffles()
    nodes = merged(scratch, table, nodes, sets, lambda pairs: _linked(scratch, pairs, sets, SHINGLE, PERCENT), tasks, cell_rows, rounds, sketches_allow)
    out = named(scratch, meta, classes, nodes)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({components_sql(SHINGLE, PERCENT)})"
