"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Numbers, units after numbers, and names (capitalised words inside a sentence)
become typed placeholders; other words are lower-cased. Windows of 8 template
tokens are hash-joined: a benchmark window is found through its longest literal
word, and where a document has that word, the hash of the template window at
the same offset must agree. So all words of all documents are looked up, and
only windows around a benchmark's long words are ever built.
Hits are grouped by document, item and alignment. A slot is consistent if its
value in the item stands for the same value in the document as in most of the
alignment's other slots; where under half of the slots are, the windows with the
others are dropped. So a question with other numbers or names is still caught,
equal values in different roles too, while a chance likeness of templates is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, MIN_LITERALS, MIN_SHARE = 8, 5, 0.25
#: So many matching windows of one alignment count whatever the item's length: a passage of 20 tokens.
MIN_RUN = 13
#: Benchmark windows up to which their side is broadcast (some 30 MB); above, what documents have near a marked word is shuffled to them.
BROADCAST_WINDOWS = 500_000
#: Bits of the marks (16 MB, broadcast) that tell which words of documents may be anchors, and bits in a page of them.
MARK_BITS, PAGE = 27, 32768
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
#: Stand for '.' and ',' between digits, so that a decimal or grouped number is one token.
POINT, COMMA = "\ue000", "\ue001"
UNITS = "km|m|cm|mm|kg|g|mg|t|l|ml|s|min|h|hours?|minutes?|seconds?|days?|weeks?|years?|meters?|metres?|miles?|feet|inches|pounds?|dollars?|euros?|percent|usd|eur|mph|kmh|degrees?"


#: Other than ASCII letters, digits and markers; from Latin-1 on, only signs and general punctuation separate.
SEPARATORS = "[\\x00\\x04-/:-@\\[-`{-\\xa9\\xab-\\xb4\\xb6-\\xb9\\xbb-\\xbf\\xd7\\xf7\\u2000-\\u206f\\u3000-\\u3003]+"


def marked_tokens(text: Column) -> Column:
    """array<string> of lower-cased words (an empty one may stand at either end); a slot's word follows its marker. Markers in the text itself are dropped."""
    t = F.translate(F.coalesce(text, F.lit("")), NUMBER + UNIT + NAME + POINT + COMMA, "     ")
    whole = F.regexp_replace(F.regexp_replace(t, "(?<=[0-9])[.](?=[0-9])", POINT), "(?<=[0-9]),(?=[0-9])", COMMA)
    t = F.when(t.rlike("[0-9]"), F.regexp_replace(whole, f"([0-9]+(?:[{POINT}{COMMA}][0-9]+)*)", NUMBER + "$1 ")).otherwise(t)
    t = F.when(F.instr(t, NUMBER) > 0, F.regexp_replace(t, rf"(\x01[0-9{POINT}{COMMA}]+ \s*)((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", "$1" + UNIT + "$2")).otherwise(t)
    t = F.regexp_replace(t, r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;:] )", " " + NAME)
    return F.split(F.lower(t), SEPARATORS)


def templates(tokens: Column) -> Column:
    """The tokens with slots reduced to their markers."""
    return F.transform(tokens, lambda w: F.when(w < F.lit("\x04"), F.substring(w, 1, 1)).otherwise(w))


def window_hash(tokens: Column, start: Column) -> Column:
    """Hash of the template of the WINDOW tokens from start (0-based)."""
    return F.xxhash64(templates(F.slice(tokens, start + 1, WINDOW)))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(anchor, offset, w, item, ipos, total, slots): windows with enough literal words, each with its longest one."""
    tok = benchmark.select(F.col(item_col).alias("item"), F.filter(marked_tokens(F.col(text_col)), lambda w: w != "").alias("tok")).dropDuplicates()
    starts = F.when(F.size("tok") >= WINDOW, F.sequence(F.lit(0), F.size("tok") - WINDOW))
    each = tok.select("item", "tok", F.explode(starts).alias("ipos")).withColumn("slots", F.slice("tok", F.col("ipos") + 1, WINDOW)).withColumn("w", window_hash(F.col("tok"), F.col("ipos")))
    literal = F.filter("slots", lambda w: w >= F.lit("\x04"))
    each = each.where(F.size(literal) >= MIN_LITERALS)
    longest = F.array_max(F.transform(literal, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    each = each.withColumn("anchor", longest).withColumn("offset", F.array_position("slots", F.col("anchor")).cast("int") - 1)
    total = each.groupBy("item").agg(F.countDistinct("ipos").alias("total"))
    return each.join(total, "item").select("anchor", "offset", "w", "item", "ipos", "total", "slots")


def conflicts(pairs: Column) -> Column:
    """Item positions of the slots (at, i, d) whose item value mostly stands for another value; of equally frequent ones the smallest counts."""
    kinds = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))))
    values = F.array_distinct(F.transform(pairs, lambda p: p["i"]))
    counted = F.transform(kinds, lambda k: F.struct(k["i"].alias("i"), (-F.size(F.filter(pairs, lambda p: (p["i"] == k["i"]) & (p["d"] == k["d"])))).alias("c"), k["d"].alias("d")))
    main = F.transform(values, lambda v: F.array_min(F.filter(counted, lambda k: k["i"] == v)))
    fits = F.transform(main, lambda m: F.struct(m["i"].alias("i"), m["d"].alias("d")))
    other = F.filter(pairs, lambda p: ~F.array_contains(fits, F.struct(p["i"].alias("i"), p["d"].alias("d"))))
    none = F.array().cast("array<int>")
    return F.when(F.size(values) == F.size(kinds), none).otherwise(F.transform(other, lambda p: p["at"]))


def anchor_marks(anchors: DataFrame) -> DataFrame:
    """(page, marks): a bit for each anchor's hash; at most 2^MARK_BITS bits, whatever the benchmark's size."""
    spot = F.shiftrightunsigned(F.xxhash64("anchor"), 64 - MARK_BITS)
    return anchors.select(F.floor(spot / PAGE).cast("long").alias("page"), (spot % PAGE).alias("bit")).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("marks"))


def near_anchors(every: DataFrame, spots: DataFrame, few: bool, size: Column) -> DataFrame:
    """(doc, dpos, part, offset's other columns): the `size` tokens around each place where a document has an anchor at its offset.

    every: doc, tok, pos, anchor, one row a token. spots: anchor, offset, and
    what size needs. Few spots are broadcast and the token array never leaves
    its task. Otherwise tokens whose word is marked travel with what may lie
    around them, and meet the spots by a shuffle; AQE splits a frequent word.
    """
    others = [c for c in spots.columns if c not in ("anchor", "offset")]
    if few:
        near = every.join(F.broadcast(spots), "anchor").withColumn("dpos", F.col("pos") - F.col("offset"))
        near = near.where((F.col("dpos") >= 0) & (F.col("dpos") + size <= F.size("tok")))
        # The planner may cut before it filters, so a cut never starts before the text.
        return near.select("doc", "dpos", F.slice("tok", F.greatest(F.col("dpos"), F.lit(0)) + 1, size).alias("part"), *others)
    reach = spots.agg(F.max("offset").alias("before_"), F.max(size - F.col("offset")).alias("after_"))
    spot = F.shiftrightunsigned(F.xxhash64("anchor"), 64 - MARK_BITS)
    byte = F.conv(F.hex(F.expr(f"substring(marks, cast((spot_ % {PAGE}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    some = every.where("anchor is not null").withColumn("spot_", spot).withColumn("page", F.floor(F.col("spot_") / PAGE).cast("long")).join(F.broadcast(anchor_marks(spots.select("anchor").distinct())), "page")
    some = some.withColumn("b_", byte).where("(shiftright(b_, cast(spot_ % 8 as int)) & 1) = 1").join(F.broadcast(reach))
    left = F.least("pos", "before_")
    around = some.select("doc", "anchor", "pos", left.alias("left_"), F.slice("tok", F.col("pos") - left + 1, left + F.col("after_")).alias("ctx_"))
    near = around.join(spots, "anchor").withColumn("from_", F.col("left_") - F.col("offset"))
    near = near.where((F.col("from_") >= 0) & (F.col("from_") + size <= F.size("ctx_")))
    return near.select("doc", (F.col("pos") - F.col("offset")).alias("dpos"), F.slice("ctx_", F.greatest(F.col("from_"), F.lit(0)) + 1, size).alias("part"), *others)


def plain_tokens(text: Column) -> Column:
    """array<string> of lower-cased words, slots and all (an empty one may stand at either end)."""
    return F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), NUMBER + UNIT + NAME, "   ")), SEPARATORS)


def whole_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, words, anchor, offset, size): items with their longest word."""
    each = benchmark.select(F.col(item_col).alias("item"), F.filter(plain_tokens(F.col(text_col)), lambda w: w != "").alias("words")).where(F.size("words") > 0).dropDuplicates()
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    each = each.withColumn("anchor", longest)
    return each.withColumn("offset", F.array_position("words", F.col("anchor")).cast("int") - 1).withColumn("size", F.size("words"))


def _whole_matches(tok: DataFrame, whole: DataFrame, n_items: int) -> DataFrame:
    """Documents that have all words of an item in a row, compared word by word."""
    spots = whole.select("anchor", "offset", "size").distinct()
    keys = whole.select(F.xxhash64("words").alias("w"), "words", "item").distinct()
    few = n_items <= BROADCAST_WINDOWS
    every = tok.select("doc", "tok", F.posexplode("tok").alias("pos", "anchor"))
    near = near_anchors(every, spots, few, F.col("size")).select("doc", "part").distinct()
    keys = F.broadcast(keys) if few else keys
    hit = near.withColumn("w", F.xxhash64("part")).join(keys, "w").where("part = words").select("doc", "item").distinct()
    one = F.lit(1).cast("long")
    return hit.select("doc", "item", one.alias("total"), one.alias("n_matched"), F.lit(True).alias("verbatim"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_windows, n_matched, share, verbatim): documents that hold a quarter or more of an item's windows, or MIN_RUN in one alignment.

    A document id at most once an item; of rows that share an id, each may bring windows. Other columns are ignored, whatever
    their names; a text of any length is read whole. Items of under 8 tokens or without a
    window of 5 literal words are found where a document has all their words in
    a row, as one window. Null, empty and wordless texts match nothing; repeated
    documents and items give the same rows once. Either table empty: no rows.
    """
    items = benchmark
    bench = benchmark_windows(benchmark, item_col, item_text).persist()
    spots = bench.select("anchor", "offset").distinct()
    few = bench.count() <= BROADCAST_WINDOWS
    bench = F.broadcast(bench) if few else bench
    tok = docs.select(F.col(id_col).alias("doc"), marked_tokens(F.col(text_col)).alias("tok"))
    # Generate, join and slice are one generated stage, in which the token array is carried by reference; what
    # needs interpretation (hashes, slots) comes after it, over the window's own tokens. The hash is the key of a
    # second join, not a filter, which would be pushed into the first. Empty ends of a text equal no anchor.
    every = tok.select("doc", "tok", F.posexplode_outer("tok").alias("pos", "anchor"))
    near = near_anchors(every, spots, few, F.lit(WINDOW))
    keyed = near.select("doc", "dpos", "part", F.xxhash64(templates(F.col("part"))).alias("w"))
    hit = keyed.join(bench, "w").select("doc", "item", "total", "ipos", (F.col("dpos") - F.col("ipos")).alias("line"), "slots", "part")
    is_slot = lambda x: x < F.lit("\x04")
    zipped = F.arrays_zip(F.col("slots").alias("i"), F.col("part").alias("d"))
    pair = F.filter(F.transform(zipped, lambda p, k: F.struct((F.col("ipos") + k).alias("at"), p["i"].alias("i"), p["d"].alias("d"))), lambda p: is_slot(p["i"]))
    hit = hit.select("doc", "item", "total", "line", "ipos", pair.alias("pairs"))
    lines = hit.groupBy("doc", "item", "total", "line").agg(F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    bad = conflicts(F.col("pairs"))
    lines = lines.withColumn("bad", bad).withColumn("same", F.forall("pairs", lambda p: p["i"] == p["d"]))
    clear = F.filter("at", lambda x: ~F.exists("bad", lambda b: (b >= x) & (b < x + WINDOW)))
    lines = lines.withColumn("at", F.when(2 * F.size("bad") <= F.size("pairs"), F.col("at")).otherwise(clear))
    found = lines.select("doc", "item", "total", "same", F.size("at").alias("run"), F.explode("at").alias("ipos")).groupBy("doc", "item", "total").agg(F.countDistinct("ipos").alias("n_matched"), F.bool_and("same").alias("verbatim"), F.max("run").alias("run"))
    enough = (F.col("n_matched") >= F.least(F.lit(3), F.col("total"))) & (F.col("n_matched") >= MIN_SHARE * F.col("total"))
    found = found.where(enough | (F.col("run") >= MIN_RUN)).drop("run")
    whole = whole_items(items, item_col, item_text).join(bench.select("item").distinct(), "item", "left_anti").persist()
    n_whole = whole.count()
    if n_whole:
        found = found.unionByName(_whole_matches(docs.select(F.col(id_col).alias("doc"), plain_tokens(F.col(text_col)).alias("tok")), whole, n_whole))
    return found.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("total").alias("n_windows"), "n_matched", (F.col("n_matched") / F.col("total")).alias("share"), "verbatim"
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
