"""Exact dedup over an extendible-hash index on shared files (DataFrame functions only).

Every row has an entry (id, 64-bit hash, SHA-256). The directory starts as one
bucket over all hashes; a bucket that is overfull splits on its next bit, and the
directory doubles when a bucket has used all its bits. Buckets in key order, and
the ways of one that cannot be split (copies of one text), are the owners: an
owner takes its key range of entries and writes it to the index in the shared
folder, so no owner holds much more than the capacity.
Two texts can only be equal where a hash stands twice in the index. A last
doubling of the directory to one bit a cell marks the cells with such a hash;
only texts in marked cells travel, to the owner of their key, which chains the
texts of one hash and compares their bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._spread import split_join

#: Most bits of the directory that the driver splits (65,536 counts), and most bits of its marks (16 MB, broadcast).
MAX_DEPTH, MAX_MARK_BITS = 16, 27
_PAGE = 32768


def normalised(text: Column) -> Column:
    """Null is empty; every run of space or 0x09-0x0D is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(counts: dict[int, int], capacity: int, depth: int) -> dict[int, tuple[int, int, int]]:
    """Cell of the leading `depth` bits -> (first owner, ways, local depth), from the rows in each occupied cell.

    Starts with one bucket over all cells; an overfull one splits on its next
    bit until it fits the capacity or is a single cell, which then has as many
    ways (owners) as it needs. Owners are numbered in key order.
    """
    buckets: list[tuple[int, int, list[int]]] = []
    open_buckets = [(0, 0, sorted(counts))]
    while open_buckets:
        prefix, local, cells = open_buckets.pop()
        if local == depth or sum(counts[c] for c in cells) <= capacity:
            buckets.append((prefix << (depth - local), local, cells))
            continue
        bit = depth - local - 1
        for side in (0, 1):
            if part := [c for c in cells if (c >> bit) & 1 == side]:
                open_buckets.append((2 * prefix + side, local + 1, part))
    out: dict[int, tuple[int, int, int]] = {}
    owner = 0
    for _, local, cells in sorted(buckets):
        ways = max(1, -(-sum(counts[c] for c in cells) // capacity))
        out.update((c, (owner, ways, local)) for c in cells)
        owner += ways
    return out


def _leading(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


class Index:
    """The index of a table's texts: `files` (id_, h, sha, owner), one key range an owner."""

    def __init__(self, scratch: Scratch, norm: DataFrame, capacity: int | None = None, max_depth: int = MAX_DEPTH):
        spark = scratch.spark
        flat = scratch.table(norm.select("id_", F.xxhash64("norm").alias("h"), F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")))
        self.rows = flat.count()
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.capacity = capacity or max(1000, -(-self.rows // (2 * tasks)))
        self.depth = min(max_depth, max(1, math.ceil(math.log2(max(2, self.rows / self.capacity))) + 4))
        # At most 2^depth counts come to the driver, and as many entries are broadcast.
        counts = {r["cell"]: r["n"] for r in flat.groupBy(_leading("h", self.depth).alias("cell")).agg(F.count("*").alias("n")).collect()}
        self.cells = directory(counts, self.capacity, self.depth)
        self.owners = max((o + w for o, w, _ in self.cells.values()), default=1)
        table = [(c, o, w) for c, (o, w, _) in self.cells.items()]
        self._dirs = F.broadcast(spark.createDataFrame(table, "cell long, first_owner int, ways int"))
        self.files = scratch.table(self.owned(flat).sortWithinPartitions("h"))

    def owned(self, rows: DataFrame) -> DataFrame:
        """rows (id_, h, ...) at the owners of their keys, with the owner's number."""
        at = rows.withColumn("cell", _leading("h", self.depth)).join(self._dirs, "cell")
        owner = F.col("first_owner") + F.pmod(F.xxhash64("id_"), F.col("ways")).cast("int")
        return at.withColumn("owner", owner).drop("cell", "first_owner", "ways").repartitionById(self.owners, "owner")

    def marks(self) -> tuple[int, DataFrame]:
        """(bits, pages (page, marks)): which cells of a directory of that depth have a hash that stands twice; some 16 cells a row, up to the bound."""
        bits = min(MAX_MARK_BITS, max(16, math.ceil(math.log2(max(1, self.rows))) + 4))
        twice = self.files.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        cell = _leading("h", bits)
        return bits, twice.groupBy(F.floor(cell / _PAGE).cast("long").alias("page")).agg(F.expr(f"bitmap_construct_agg(shiftrightunsigned(h, {64 - bits}) % {_PAGE})").alias("marks"))


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, owner.

    Equal: identical normalised bytes; the smallest id stays. Null text counts as
    empty and all empty texts are one group. Repeated rows are rows like others:
    all with the smallest id are kept. A null id is never the smallest; where all
    ids of a group are null, keep_id is null and all are kept. Empty input: no
    rows. Other columns of docs are ignored, whatever their names. Two different
    texts under one SHA-256 would stop the job with an error, not merge.
    """
    scratch = Scratch(spark, "exact")
    norm = docs.select(F.col(id_col).alias("id_"), normalised(F.col(text_col)).alias("norm"))
    index = Index(scratch, norm, capacity, max_depth)
    bits, pages = index.marks()
    # Bounded by MAX_MARK_BITS, whatever the input.
    pages = F.broadcast(scratch.table(pages))
    cell = F.shiftrightunsigned("h", 64 - bits)
    byte = F.conv(F.hex(F.expr("substring(marks, cast((c_ % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = norm.withColumn("h", F.xxhash64("norm")).withColumn("c_", cell).withColumn("page", F.floor(F.col("c_") / _PAGE).cast("long")).join(pages, "page")
    marked = marked.withColumn("b_", byte).where("(shiftright(b_, cast(c_ % 8 as int)) & 1) = 1")
    chained = index.owned(marked.select("id_", "h", "norm")).groupBy("owner", "h", "norm").agg(F.min("id_").alias("keep_id"), F.count("*").alias("group_size"))
    entries = chained.select("owner", "h", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "keep_id", "group_size")
    one = entries.groupBy("owner", "h", "sha").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("chain"))
    one = one.withColumn("group_size", F.when(F.col("chain") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two different texts share a SHA-256"))))
    # The ways of a key that one owner could not hold.
    one = scratch.table(one.groupBy("h", "sha").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    scratch.free_shuffles()
    found = split_join(index.files, one.withColumn("in_", F.lit(True)), ["h", "sha"], "group_size", index.rows)
    keep = F.when(F.col("in_"), F.col("keep_id")).otherwise(F.col("id_"))
    return found.withColumn("keep_", keep).select(
        F.col("id_").alias(id_col),
        F.col("keep_").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id_").eqNullSafe(F.col("keep_")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "owner",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("owner")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
