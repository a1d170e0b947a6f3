"""Language ID: multinomial naive Bayes over hashed character n-grams.

Character 1- to 3-grams of the lower-cased text (other than letters reads as one
space) hash into a fixed number of buckets. Training sums bucket counts per
language in the executors; the log-probability matrix (buckets x languages) is
broadcast, and a batch is scored by gathering its grams' rows and summing them
per text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, mix, tidy, utf8_chunks
from ._scratch import bound_batches

BUCKETS = 1 << 15
#: About so many labelled documents are learnt from, chosen by a hash of the id.
MAX_TRAIN = 12_000
#: With more languages than this, learning stops with an error: the matrix, 4 bytes x BUCKETS a language, is held by every worker.
MAX_LANGS = 1000
#: Counts that a task holds before it adds up equal ones.
_HELD = 1 << 21
_TOP = 0x250
_fold: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if a letter, else a space; whether it is a letter."""
    global _fold
    if _fold is None:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        lower = np.where(letter, np.arange(0x110000), 32).astype(np.uint32)
        for c in range(0x2000):
            if letter[c] and len(chr(c).lower()) == 1:
                lower[c] = ord(chr(c).lower())
        _fold = lower, letter
    return _fold


def grams(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each gram, text of each gram, letters per text) for a chunk of texts."""
    lower, letter = _tables()
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offs]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(cp)
    text = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(at))
    n_letters = np.bincount(text, weights=letter[cp], minlength=len(offs) - 1)
    c = lower[cp]
    used = c != 32
    keep = used | np.concatenate([[True], used[:-1]]) if n else used  # one space between words
    c, text = c[keep].astype(U64), text[keep]
    outs, owners = [], []
    h = np.zeros(len(c), U64)
    for k in range(3):
        m = len(c) - k
        if m <= 0:
            break
        h = h[:m] * U64(0x100000001B3) + c[k:] + U64(k + 1)
        same = text[:m] == text[k:]
        outs.append((mix(h) & U64(buckets - 1)).astype(np.int32)[same])
        owners.append(text[:m][same])
    if not outs:
        z = np.zeros(0, np.int32)
        return z, z, n_letters
    return np.concatenate(outs), np.concatenate(owners), n_letters


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", buckets: int = BUCKETS, max_docs: int = MAX_TRAIN, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """(languages, float32[buckets + 1, languages]): log-probabilities, and in the last row the log-priors.

    Every language of docs is learnt; more than max_langs of them are an error. What
    reaches the driver is at most languages x buckets counts. Rows without text or
    language teach nothing; repeated rows teach as often as they stand. Empty docs:
    no language.
    """
    bound_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # One row more than max_langs comes to the driver at most.
    found = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(max_langs + 1).collect()
    if len(found) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs, at {4 * buckets} bytes a language in every worker")
    sizes = {r["lang"]: r["n"] for r in found}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((buckets + 1, 0), np.float32)
    # Each language gives up to an equal share, so a rare one is learnt whole.
    share = max_docs / len(langs)
    rate = F.create_map(*[F.lit(x) for la in langs for x in (la, min(1.0, share / sizes[la]))])
    picked = known.where(F.pmod(F.xxhash64(F.lit("nb"), id_col), F.lit(1_000_000)) < F.element_at(rate, F.col(lang_col)) * 1_000_000)
    number = {la: i for i, la in enumerate(langs)}

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        key, at = np.unique(key, return_inverse=True)
        return key, np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, data, offs in utf8_chunks(batch.column(0)):
                g, t, _ = grams(data, offs, buckets)
                held.append(np.unique(lang[a:b][t] * buckets + g, return_counts=True))
                if sum(len(k) for k, _ in held) > _HELD:
                    held = [added(held)]
        key, n = added(held)
        yield pa.RecordBatch.from_arrays([pa.array((key // buckets).astype(np.int32)), pa.array((key % buckets).astype(np.int32)), pa.array(n)], ["k", "g", "n"])

    counts = picked.select(text_col, lang_col).mapInArrow(tidy(count), "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values("k")
    cuts = np.searchsorted(counts["k"].to_numpy(), np.arange(len(langs) + 1))
    gram, n = counts["g"].to_numpy(), counts["n"].to_numpy()
    matrix = np.empty((buckets + 1, len(langs)), np.float32)
    for j, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        total = np.ones(buckets)
        total[gram[lo:hi]] += n[lo:hi]
        matrix[:-1, j] = np.log(total / total.sum())
    matrix[-1] = np.log(np.array([sizes[la] for la in langs]) / sum(sizes.values()))
    return langs, matrix


def score(data: np.ndarray, offs: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its posterior, letters) for each text of a chunk."""
    buckets, n_lang = len(matrix) - 1, matrix.shape[1]
    g, t, letters = grams(data, offs, buckets)
    n = len(offs) - 1
    total = np.stack([np.bincount(t, weights=matrix[g, j], minlength=n) for j in range(n_lang)], axis=1) + matrix[-1]
    best = total.argmax(axis=1)
    total -= total.max(axis=1, keepdims=True)
    return best, 1 / np.exp(total).sum(axis=1), letters


def predict(spark: SparkSession, docs: DataFrame, langs: list[str], matrix: np.ndarray, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with pred_col and score_col after its own columns (which must not have these names).

    `und` with score 0 where the text is null or without a letter, and
    everywhere if nothing was learnt. Ties go to the first language by name.
    Whole texts of any length are read in pieces of whole texts; rows are
    independent, so repeated rows give repeated results. Empty docs: no rows.
    """
    shared = spark.sparkContext.broadcast(matrix)
    at = docs.columns.index(text_col)
    names = np.array([*langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            best, sc = np.full(n, len(langs)), np.zeros(n)
            for a, b, data, offs in utf8_chunks(batch.column(at), 1 << 19):
                if langs:
                    k, p, letters = score(data, offs, m)
                    has = letters > 0
                    best[a:b], sc[a:b] = np.where(has, k, len(langs)), np.where(has, p, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(sc)], [*batch.schema.names, pred_col, score_col])

    schema = docs.select("*", F.lit("").alias(pred_col), F.lit(0.0).alias(score_col)).schema
    return docs.mapInArrow(tidy(run), schema)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, matrix = train(learnable(docs))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = predict(spark, docs.select("doc_id", held.alias("held_out"), "text"), langs, matrix)
    return out.select("doc_id", "held_out", "lang_pred", "score")
