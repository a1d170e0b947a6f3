"""Toxicity: two class-conditional Kneser-Ney bigram models over shared backoffs.

p_c(w | h) discounts class c's bigram counts and backs off to class c's
continuation counts of the word, these to class c's continuation counts of the
word's stem (its first STEM bytes) times the share that both classes together
give the word among those of its stem, and these to the stem's counts in both
classes. So an inflected form that no labelled text has still gets its stem's
evidence, and only what neither class has seen in any form gets none. A text's
evidence is its length-normalised log-likelihood ratio: over the whole text, and
over its strongest stretches; a logistic fit on labelled rows kept out of the
counts turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import NOT_ALNUM, U64, lowered, mix, span_hashes, utf8_chunks, word_spans
from ._scratch import Scratch

#: At most about so many labelled documents of each class are counted, and as many again calibrate.
MAX_TRAIN, DISCOUNT, STRETCH, STEM = 5000, 0.75, 12, 5


def _bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


def stemmed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the first STEM bytes, text) of each word, in order."""
    low = lowered(data)
    s, e, t = word_spans(low, offs, NOT_ALNUM)
    if not len(s):
        return np.zeros(0, U64), np.zeros(0, U64), t
    return span_hashes(low, s, e), span_hashes(low, s, np.minimum(e, s + STEM)), t


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class KneserNey:
    word: np.ndarray  # sorted hashes of the words of the sample
    word_p: np.ndarray  # [2, words] p_c(w)
    head: np.ndarray  # sorted hashes of first words with class counts
    head_back: np.ndarray  # [2, heads] weight of the backoff after h
    head_total: np.ndarray  # [2, heads]
    pair: np.ndarray  # sorted hashes of the bigrams of the sample
    pair_n: np.ndarray  # [2, pairs]
    stem: np.ndarray  # sorted hashes of the stems of the sample
    stem_p: np.ndarray  # [2, stems] p_c of a word outside `word` that has this stem
    rare_p: np.ndarray  # [2] p_c of a word of another stem
    weights: np.ndarray  # of the logistic fit
    shared: Broadcast | None = None  # the counts, sent to the executors once for calibration and prediction

    def ratio(self, h: np.ndarray, stem: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log p_1 - log p_0 of each word after its predecessor in the same text; 0 stands before a text's first word."""
        q = self.probabilities(h, stem, t)
        return np.log(q[1] / q[0])

    def probabilities(self, h: np.ndarray, stem: np.ndarray, t: np.ndarray) -> np.ndarray:
        """[2, words] p_c(w | predecessor): the discounted bigram count, and the predecessor's backoff weight times p_c(w)."""
        at, known = _find(self.word, h)
        sat, inflected = _find(self.stem, stem)
        q = np.where(inflected, self.stem_p[:, sat] if len(self.stem) else 0.0, self.rare_p[:, None])
        q = np.where(known, self.word_p[:, at] if len(self.word) else 0.0, q)
        if not len(self.head) or not len(h):
            return q
        before = np.concatenate([[U64(0)], h[:-1]])
        before[np.concatenate([[True], t[1:] != t[:-1]])] = 0
        hat, has = _find(self.head, before)
        # A predecessor that a class never saw has weight 1 there.
        q *= np.where(has, self.head_back[:, hat], 1.0)
        pat, seen = _find(self.pair, _bigram(before, h))
        some = np.flatnonzero(seen & has)
        pat, hat = pat[some], hat[some]
        q[:, some] += np.maximum(self.pair_n[:, pat] - DISCOUNT, 0) / np.maximum(self.head_total[:, hat], 1)
        return q

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """[texts, 5]: 1, mean ratio, ratio over sqrt(length), strongest stretch, strongest two words."""
        n = len(offs) - 1
        h, stem, t = stemmed_words(data, offs)
        out = np.zeros((n, 5))
        out[:, 0] = 1
        if not len(h):
            return out
        r = self.ratio(h, stem, t)
        size = np.bincount(t, minlength=n)
        total = np.bincount(t, weights=r, minlength=n)
        some = size > 0
        out[some, 1] = total[some] / size[some]
        out[some, 2] = total[some] / np.sqrt(size[some])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        run = np.concatenate([[0.0], np.cumsum(r)])
        i = np.arange(len(h))
        end = np.minimum(i + STRETCH, first[t] + size[t])
        stretch = (run[end] - run[i]) / STRETCH
        out[some, 3] = np.maximum.reduceat(stretch, first[some])
        best = np.maximum.reduceat(r, first[some])
        clipped = r.copy()
        top = np.flatnonzero(r == np.repeat(best, size[some]))
        keep = np.unique(t[top], return_index=True)[1]
        clipped[top[keep]] = 0
        out[some, 4] = best + np.maximum.reduceat(clipped, first[some])
        return out



def sample_labels(labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[DataFrame, tuple[float, float]]:
    """(about `limit` rows of each class of (id_, toxic), chosen by a hash of the id; the rate of each class).

    An id that is labelled several times counts once, as toxic if any label says so.
    """
    known = labels.where("toxic in (0, 1) and id_ is not null").groupBy("id_").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rates = tuple(min(1.0, limit / sizes[c]) if sizes.get(c) else 0.0 for c in (0, 1))
    rate = F.when(F.col("toxic") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    return known.where(F.pmod(F.xxhash64(F.lit("kn"), "id_"), F.lit(1_000_000)) < rate * 1_000_000), rates


def _score(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(labelled: DataFrame, rates: tuple[float, float] = (1.0, 1.0)) -> KneserNey:
    """From a bounded sample (id_, text, toxic); counts on three of four rows, calibration on the fourth.

    Bigram counts are summed in the executors; what comes to the driver are
    bigrams and words of that sample, as Arrow columns. rates: what share of each
    class the sample has. Null texts teach nothing; without both classes every score is 0.
    """
    known = labelled.where("text is not null and toxic in (0, 1)")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id_"), F.lit(4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offs in utf8_chunks(batch.column(0)):
                h, stem, t = stemmed_words(data, offs)
                if not len(h):
                    continue
                before = np.concatenate([[U64(0)], h[:-1]])
                before[np.concatenate([[True], t[1:] != t[:-1]])] = 0
                both = np.rec.fromarrays([before, h, stem, toxic[a:b][t]], names="h,w,s,c")
                u, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(u[c].view(np.int64)) for c in "hws"), pa.array((n * (u["c"] == 0)).astype(np.int64)), pa.array((n * (u["c"] == 1)).astype(np.int64))], ["h", "w", "s", "n0", "n1"])

    pairs = known.where(fold > 0).select("text", "toxic").mapInArrow(count, "h long, w long, s long, n0 long, n1 long")
    pairs = pairs.groupBy("h", "w", "s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    cont = pairs.groupBy("w", "s").agg(F.count_if(F.col("n0") > 0).alias("k0"), F.count_if(F.col("n1") > 0).alias("k1"), F.count("*").alias("k"))
    tot = cont.agg(F.sum("k0"), F.sum("k1"), F.sum("k"), F.count_if(F.col("k0") > 0), F.count_if(F.col("k1") > 0), F.count("*")).first()
    k0_all, k1_all, k_all, t0, t1, types = (float(x or 0) for x in tot)
    heads = pairs.groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, _, n0, n1 = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(_bigram(h.view(np.uint64), w.view(np.uint64)).view(np.int64)), pa.array(n0.astype(np.int32)), pa.array(n1.astype(np.int32))], ["k", "n0", "n1"])

    def columns(df: DataFrame) -> dict[str, np.ndarray]:
        table = df.toArrow()
        return {c: table[c].to_numpy() for c in table.column_names}

    wt, hd = columns(cont), columns(heads)
    bg = columns(pairs.mapInArrow(packed, "k long, n0 int, n1 int"))
    pairs.unpersist()

    def order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        o = np.argsort(k)
        return k[o], o

    def both(table: dict[str, np.ndarray], name: str, o: np.ndarray) -> np.ndarray:
        return np.stack([table[f"{name}{c}"][o] for c in (0, 1)]).astype(float)

    d = DISCOUNT
    word, o = order(wt["w"])
    k = both(wt, "k", o)
    k_w, stems = wt["k"][o].astype(float), wt["s"][o].astype(np.int64).view(np.uint64)
    stem, of = np.unique(stems, return_inverse=True)
    many = max(1.0, k_all)
    per_stem = lambda x: np.bincount(of, weights=x, minlength=len(stem))
    k_s, words_s, k_cs = per_stem(k_w), per_stem(np.ones(len(of))), np.stack([per_stem(k[c]) for c in (0, 1)])
    alls, kinds = np.array([k0_all, k1_all]), np.array([t0, t1])

    def backoff(kinds: np.ndarray) -> np.ndarray:
        return np.where(alls == 0, 1.0, d * kinds / np.maximum(alls, 1))

    base = d * len(stem) / many / (len(stem) + 1)  # the shared mass of a stem never seen, alike for both classes
    shared = np.maximum(k_s - d, 0) / many + base
    p_s = np.maximum(k_cs - d, 0) / np.maximum(alls, 1)[:, None] + backoff((k_cs > 0).sum(axis=1))[:, None] * shared
    new = d * words_s / np.maximum(k_s, 1) / (words_s + 1)  # the share of a form never seen among its stem's words
    below = backoff(kinds)[:, None] * p_s
    p = np.maximum(k - d, 0) / np.maximum(alls, 1)[:, None] + below[:, of] * (np.maximum(k_w - d, 0) / np.maximum(k_s, 1)[of] + new[of])
    rare = np.full(2, base)
    head, o = order(hd["h"])
    total = both(hd, "n", o)
    hback = d * both(hd, "t", o) / np.maximum(total, 1)
    hback[total == 0] = 1.0
    pair, o = order(bg["k"])
    n = np.stack([bg["n0"][o], bg["n1"][o]])
    n = n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.int32)
    model = KneserNey(word, p, head, hback, total.astype(np.int32), pair, n, stem, below * new, rare, np.array([-30.0, 0, 0, 0, 0]))
    model.shared = labelled.sparkSession.sparkContext.broadcast(model)
    if min(rates) > 0:
        xy = np.array(_featured(known.where(fold == 0).select("text", "toxic"), model, "toxic").collect(), float).reshape(-1, 6)
        if len(xy) and 0 < xy[:, 5].mean() < 1:
            # Classes were picked at different rates: give each its share of the whole back.
            model.weights = _logistic(xy[:, :5], xy[:, 5])
            model.weights[0] += np.log(rates[0] / rates[1])
    return model


def _featured(rows: DataFrame, model: KneserNey, extra: str) -> DataFrame:
    shared = model.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.concatenate([m.features(data, offs) for _, _, data, offs in utf8_chunks(batch.column(0))] or [np.zeros((0, 5))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(5)), batch.column(1).cast(pa.float64())], [*(f"x{j}" for j in range(5)), "y"])

    return rows.select("text", extra).mapInArrow(run, ", ".join(f"x{j} double" for j in range(5)) + ", y double")


def predict(spark: SparkSession, docs: DataFrame, model: KneserNey, text_col: str = "text", score_col: str = "score", pred_col: str = "predicted") -> DataFrame:
    """docs (without text_col) with score_col and pred_col, names that docs must not have.

    Null, empty and wordless texts score as a text without evidence. Whole texts
    of any length count; rows are independent, so repeated rows give repeated
    results. Empty docs: no rows.
    """
    shared, weights = model.shared, model.weights
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            sc = np.concatenate([_score(m.features(data, offs), weights) for _, _, data, offs in utf8_chunks(batch.column(0))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sc), pa.array((sc >= 0.5).astype(np.int32))], [*batch.schema.names[1:], score_col, pred_col])

    schema = docs.select(*keep, F.lit(0.0).alias(score_col), F.lit(0).alias(pred_col)).schema
    return docs.select(text_col, *keep).mapInArrow(run, schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select(F.col("doc_id").alias("id_"), "toxic")
    picked, rates = sample_labels(labels)
    # Bounded by MAX_TRAIN rows a class: broadcast, so that no text is shuffled, and kept for the two passes of training.
    labelled = docs.select(F.col("doc_id").alias("id_"), "text").join(F.broadcast(picked), "id_")
    model = train(Scratch(spark, "toxic").table(labelled), rates)
    return predict(spark, docs.select("doc_id", held_out().alias("held_out"), "text"), model)
