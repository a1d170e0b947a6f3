"""Balanced label propagation over linked documents: even shards, few cut links.

Documents are linked when their texts are equal, so a group is a clique and its
links need no pairs: a document's neighbours' shards are the group's histogram
over shards, which is all that the rounds carry. Groups larger than a part of a
shard, a bounded number, settle first and by size: whole in one shard where it
fits, and else over as few shards as have room. All other linked documents start
where their id's hash says, in proportion to the room left. Each round re-reads every
group's histogram; documents in a shard with fewer of their neighbours wish to
be where most of them are. Wishes from one shard to another are granted as far
as wishes the other way make up for them or the target has room, half above
its quota, so the cut links fall with every round. What stands above a quota
then goes, by whole groups but for the last, to shards with room, and a round
under the exact quotas follows. Unlinked documents fill the quotas exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._spread import gapless_rank, split_join

SHARDS, ROUNDS, CHUNKS, SLACK = 16, 4, 4, 1.5
UNIT = ["g1", "g2"]


def place_large(votes: dict[tuple, dict[int, int]], free: list[int]) -> tuple[list[tuple], list[int]]:
    """((*group, from rank, to rank, shard) of each part of the groups, room left). votes: a group's rows by shard."""
    free, parts = list(free), []
    for group, seen in sorted(votes.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        at, n = 0, sum(seen.values())
        while at < n:
            fits = [s for s, f in enumerate(free) if f >= n - at]
            # The tightest shard that takes all that is left, or else the emptiest.
            s = min(fits, key=lambda s: (free[s], -seen.get(s, 0), s)) if fits else max(range(len(free)), key=lambda s: (free[s], seen.get(s, 0), -s))
            size = min(free[s], n - at)
            parts.append((*group, at, at + size, s))
            free[s] -= size
            at += size
    return parts, free


def cut_links(state: DataFrame) -> int:
    """Links between shards, of groups (g1, g2, shard, c)."""
    each = state.groupBy(*UNIT).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    return int(each.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0)


def granted(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from shard i to shard j: as many as come back, and what the target has room for."""
    room, out = list(room), {}
    for (i, j), n in sorted(wishes.items()):
        out[i, j] = min(n, wishes.get((j, i), 0))
    for (i, j), n in sorted(wishes.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[i, j], max(0, room[j]))
        out[i, j] += more
        room[j] -= more
    return {k: n for k, n in out.items() if n}


def propagate(scratch: Scratch, state: DataFrame, quota: list[int], rounds: int, rows: int) -> tuple[DataFrame, list[int], list[int]]:
    """(state after the rounds, rows in each shard, cut links before the first round and after each). state: (g1, g2, shard, c), few rows a group."""
    shards = len(quota)
    cuts = [cut_links(state)]
    load = [0] * shards
    for r in state.groupBy("shard").agg(F.sum("c").alias("s")).collect():
        load[r["shard"]] = r["s"]
    for _ in range(rounds):
        room = [q - n for q, n in zip(quota, load, strict=True)]
        # The neighbours of a group's documents, shard by shard; a full shard is no target unless some of it wish to leave.
        seen = state.groupBy(*UNIT).agg(F.max(F.struct("c", (-F.col("shard")).alias("s"))).alias("best"))
        wish = state.join(seen, UNIT).select(*UNIT, "shard", (-F.col("best.s")).alias("to"), "c", F.col("best.c").alias("there")).where("shard <> to")
        wish = scratch.table(wish)
        wishes = {(r["shard"], r["to"]): r["m"] for r in wish.groupBy("shard", "to").agg(F.sum("c").alias("m")).collect()}
        allow = granted(wishes, room)
        if not allow:
            break
        # At most shards * shards rows. The largest gains move first (of each block of the rank); what stands at the border moves in part.
        limit = F.broadcast(scratch.spark.createDataFrame([(i, j, n) for (i, j), n in allow.items()], "shard int, to int, limit_ long"))
        queued = gapless_rank(wish.join(limit, ["shard", "to"]).withColumn("gain_", -F.col("there") / F.col("c")), ["shard", "to"], ["gain_", *UNIT], rows, F.col("c"), "before")
        moved = scratch.table(queued.where("before < limit_").select(*UNIT, "shard", "to", F.least(F.col("c"), F.col("limit_") - F.col("before")).alias("m")))
        steps = moved.select(*UNIT, "shard", (-F.col("m")).alias("c")).unionByName(moved.select(*UNIT, F.col("to").alias("shard"), F.col("m").alias("c")))
        state = scratch.table(state.unionByName(steps).groupBy(*UNIT, "shard").agg(F.sum("c").alias("c")).where("c > 0"))
        for (i, j), n in allow.items():
            load[i] -= n
            load[j] += n
        cuts.append(cut_links(state))
        if cuts[-1] == cuts[-2]:
            break
    return state, load, cuts


def balanced_shards(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, report: dict | None = None) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Row counts of two shards differ by one at most. Null text: no bytes, size 1,
    and linked with the empty text. Repeated ids and rows without an id are rows
    like others. Other columns are ignored, whatever their names. Empty input: no
    rows. Driver state: shards * shards counts, and for each of at most shards *
    CHUNKS large groups its size. report: gets the cut links before
    and after each round under 'cuts'.
    """
    scratch = Scratch(spark, "shard")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    doc = ["id_", "size", "text_crc32"]
    index = scratch.table(
        docs.select(F.col(id_col).alias("id_"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("g1"), F.xxhash64(F.lit("second"), raw).alias("g2"))
    )
    rows = index.count()
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    chunk = max(2, rows // (shards * CHUNKS))
    sizes = scratch.table(index.groupBy(*UNIT).agg(F.count("*").alias("n")).where("n > 1"))
    large = {(r["g1"], r["g2"]): {0: r["n"]} for r in sizes.where(F.col("n") > chunk).collect()}
    parts, free = place_large(large, quota)
    # The others start where their id's hash falls among the rows that are left.
    spot = F.pmod(F.xxhash64("id_", F.lit(3)), F.lit(max(1, sum(free))))
    start = F.lit(None).cast("int")
    for s in reversed(range(shards)):
        start = F.when(spot < sum(free[: s + 1]), F.lit(s)).otherwise(start)
    small = split_join(index.select("id_", *UNIT), sizes, UNIT, "n", rows).where(F.col("n") <= chunk)
    # At most `shards` rows a group, combined before the shuffle.
    state = small.groupBy(*UNIT, start.alias("shard")).agg(F.count("*").alias("c"))
    state, _, cuts = propagate(scratch, scratch.table(state), [int(SLACK * f) for f in free], rounds, rows)
    state, load, last = propagate(scratch, _within(scratch, state, free, rows), free, 1, rows)
    free = [f - n for f, n in zip(free, load, strict=True)]
    if parts:
        state = state.unionByName(spark.createDataFrame([(a, b, s, hi - lo) for a, b, lo, hi, s in parts], "g1 long, g2 long, shard int, c long"))
    if report is not None:
        report["cuts"] = cuts + last
    # Where the ranks of a group's documents end, shard by shard.
    ends = state.groupBy(*UNIT).agg(F.sort_array(F.collect_list(F.struct("shard", "c"))).alias("parts")).join(sizes, UNIT)
    tagged = split_join(index, ends, UNIT, "n", rows)
    ranked = gapless_rank(tagged.where("n is not null"), UNIT, ["id_", "size"], rows, name="r_")
    reached = F.aggregate("parts", F.struct(F.col("r_").alias("left"), F.lit(-1).alias("shard")), _next_part)
    placed = ranked.select(*doc, reached["shard"].alias("shard"))
    filled = gapless_rank(tagged.where("n is null").withColumn("k_", F.lit(0)), ["k_"], ["id_", "g1"], rows, name="r_")
    shard = F.lit(None).cast("int")
    for s in reversed(range(shards)):
        shard = F.when(F.col("r_") < sum(free[: s + 1]), F.lit(s)).otherwise(shard)
    every = scratch.table(placed.unionByName(filled.select(*doc, shard.alias("shard"))))
    slots = gapless_rank(every, ["shard"], ["id_", "size", "text_crc32"], rows, name="slot")
    return slots.select(F.col("id_").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _next_part(at: Column, part: Column) -> Column:
    here = (at["shard"] < 0) & (at["left"] < part["c"])
    return F.struct(F.when(here, at["left"]).otherwise(at["left"] - part["c"]).alias("left"), F.when(here, part["shard"]).otherwise(at["shard"]).alias("shard"))


def _within(scratch: Scratch, state: DataFrame, quota: list[int], rows: int, whole: bool = True) -> DataFrame:
    """state with the rows above a shard's quota put into shards with room: the smallest parts of groups, whole while there is room to spare, then cut to fit."""
    load = [0] * len(quota)
    for r in state.groupBy("shard").agg(F.sum("c").alias("s")).collect():
        load[r["shard"]] = r["s"]
    over = [(s, n - q) for s, (n, q) in enumerate(zip(load, quota, strict=True)) if n > q]
    if not over:
        return state
    ranked = gapless_rank(state.where(F.col("shard").isin([s for s, _ in over])), ["shard"], ["c", *UNIT], rows, F.col("c"), "before")
    ranked = scratch.table(ranked.join(F.broadcast(scratch.spark.createDataFrame(over, "shard int, over_ long")), "shard").where("before < over_"))
    spare = ranked.agg(F.max("c")).first()[0] if whole else 0
    room = sorted([q - n - spare, s] for s, (n, q) in enumerate(zip(load, quota, strict=True)) if q - n > spare)
    moves = []
    for s, n in over:
        at = 0
        while at < n and room:
            take = min(room[-1][0], n - at)
            moves.append((s, at, at + take, room[-1][1]))
            at += take
            # What starts inside the range may end beyond it, by `spare` rows at most.
            room[-1][0] -= take + spare
            room = sorted(r for r in room if r[0] > 0)
    if moves:
        plan = F.broadcast(scratch.spark.createDataFrame(moves, "shard int, from_ long, to_ long, into int"))
        inside = F.col("c") if whole else F.least(F.col("before") + F.col("c"), F.col("to_")) - F.greatest("before", "from_")
        fits = "before >= from_ and before < to_" if whole else "m > 0"
        part = scratch.table(ranked.join(plan, "shard").withColumn("m", inside).where(fits).select(*UNIT, "shard", "into", "m"))
        steps = part.select(*UNIT, "shard", (-F.col("m")).alias("c")).unionByName(part.select(*UNIT, F.col("into").alias("shard"), F.col("m").alias("c")))
        state = scratch.table(state.unionByName(steps).groupBy(*UNIT, "shard").agg(F.sum("c").alias("c")).where("c > 0"))
    return _within(scratch, state, quota, rows, False) if whole else state


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
