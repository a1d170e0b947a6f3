"""A stored inverted index: blocks of equal impact by token, read as far as a query can need them.

`postings` has one row per block, partitioned by a hash of the token and sorted
by (token, tf) within: the documents in which the token occurs equally often, at
most about `block` of them, so a block's impact is one number and blocks of the
commonest tokens lie in many places. `tokens` has document frequencies and the
highest tf. A query reads the partitions of its tokens. Its k-th best score is
bounded from below by the blocks' counts, then by the partial scores of the
highest blocks; a block whose tf, with the highest of all other tokens, stays
below it can hold no document of the top k and is never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import lexical

BUCKETS, BLOCK = 32, 4096
#: Documents of the highest blocks of each token whose partial scores sharpen the bound.
PROBE = 20_000
#: Characters of text of a task that counts tokens; large blocks that are broadcast.
CHARS_A_TASK, MOST_BROADCAST = 8_000_000, 200_000


@dataclass
class PostingsIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> PostingsIndex:
        """Write the index of docs (unique keys). Null and empty texts count as documents and have no postings."""
        spark = docs.sparkSession
        n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
        # Texts travel once, by their key, so a document's tokens are counted where it lies; the terms are written once and read twice.
        parts = max(1, -(-chars // CHARS_A_TASK))
        dealt = docs.select(key, text).repartition(parts, key)
        terms = lexical.terms(dealt, key, text).select(F.col(key).alias("doc"), "token", "tf")
        terms = cut(terms.sortWithinPartitions("token", "tf", "doc"))
        # A token has at most n documents with one tf, which salts deal into blocks where there are many.
        level = cut(terms.groupBy("token", "tf").agg(F.count("*").alias("n")))
        bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket")
        large = level.where(F.col("n") > block).select("token", "tf", F.ceil(F.col("n") / block).cast("int").alias("subs"))
        many = large.count()
        # At most one in `block` of the postings; beyond a bound they are joined by a shuffle.
        large = F.broadcast(large) if many <= MOST_BROADCAST else large
        salted = terms.join(large, ["token", "tf"], "left") if many else terms.withColumn("subs", F.lit(None).cast("int"))
        sub = F.pmod(F.xxhash64("doc"), F.coalesce("subs", F.lit(1))).cast("int")
        # A bucket is written by so many tasks; each gets whole blocks.
        ways = -(-parts // buckets)
        rows = salted.select(bucket, "token", "tf", sub.alias("sub"), "doc").withColumn("way", F.pmod(F.xxhash64("tf", "token", "sub"), F.lit(ways)))
        rows = rows.repartition(buckets * ways, "bucket", "way")
        blocks = rows.groupBy("bucket", "way", "token", "tf", "sub").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
        blocks = blocks.select("bucket", "token", "tf", "sub", F.size("docs").alias("n"), "docs")
        blocks.sortWithinPartitions("bucket", "token", F.desc("tf")).write.partitionBy("bucket").parquet(f"{path}/postings")
        df = F.sum("n").alias("df")
        idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")
        tokens = level.groupBy("token").agg(df, F.max("tf").alias("max_tf")).select(bucket, "token", "df", idf, "max_tf")
        tokens.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/tokens")
        spark.createDataFrame([(n, buckets)], "documents long, buckets int").coalesce(1).write.parquet(f"{path}/meta")
        return cls(spark, path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def documents(self) -> int:
        return self._read("meta").first()["documents"]

    def tokens(self) -> DataFrame:
        """(token, df, idf, max_tf)"""
        return self._read("tokens").drop("bucket")

    def _of(self, df: DataFrame, tokens: list[str]) -> DataFrame:
        """The rows of tokens: their partitions, and in these their row groups."""
        names = self.spark.createDataFrame([(t,) for t in tokens], "token string")
        buckets = self._read("meta").first()["buckets"]
        mine = [r[0] for r in names.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).distinct().collect()]
        return df.where(F.col("bucket").isin(mine) & F.col("token").isin(tokens))

    def query_terms(self, queries: DataFrame, key: str, text: str) -> dict[str, float]:
        """{token: tf} of one query row."""
        return {r["token"]: r["tf"] for r in lexical.terms(queries, key, text).select("token", "tf").collect()}

    def top(self, terms: dict[str, float], k: int, within: DataFrame | None = None, sharpen: bool = True) -> DataFrame:
        """(doc, score): the k best documents by sum of tf * tf * idf, rounded to 6 digits, ties to the smaller key.

        within: (doc) rows that alone may be found (a filter); all blocks are
        read then, as the bound holds for all documents only.
        """
        weights = {r["token"]: (terms[r["token"]] * r["idf"], r["max_tf"]) for r in self._of(self._read("tokens"), sorted(terms)).collect()} if terms else {}
        blocks = self._read("postings")
        if not weights:
            return blocks.select(F.explode("docs").alias("doc"), F.lit(0.0).alias("score")).limit(0)
        least = self.levels(weights, k, sharpen) if within is None else dict.fromkeys(weights, 0.0)
        scored = self._scored(weights, least)
        if within is not None:
            scored = scored.join(within.select("doc").distinct(), "doc", "left_semi")
        return scored.select("doc", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc").limit(k)

    def _scored(self, weights: dict[str, tuple[float, float]], least: dict[str, float]) -> DataFrame:
        """(doc, score) from the blocks with at least that tf."""
        blocks = self._of(self._read("postings"), sorted(weights))
        wanted = F.lit(False)
        for token, tf in least.items():
            wanted = wanted | ((F.col("token") == token) & (F.col("tf") >= tf))
        each = self.spark.createDataFrame([(t, w) for t, (w, _) in weights.items()], "token string, weight double")
        rows = blocks.where(wanted).join(F.broadcast(each), "token").select(F.explode("docs").alias("doc"), (F.col("weight") * F.col("tf")).alias("part"))
        return rows.groupBy("doc").agg(F.sum("part").alias("score"))

    def levels(self, weights: dict[str, tuple[float, float]], k: int, sharpen: bool = True) -> dict[str, float]:
        """The least tf of each token whose blocks may hold a document of the top k. Reads counts, and with `sharpen` the highest blocks."""
        counts: dict[str, list[tuple[float, int]]] = {}
        for r in self._of(self._read("postings"), sorted(weights)).groupBy("token", "tf").agg(F.sum("n").alias("n")).collect():
            counts.setdefault(r["token"], []).append((r["tf"], r["n"]))
        reached, probe = 0.0, {}
        for token, rows in counts.items():
            seen = 0
            for tf, n in sorted(rows, reverse=True):
                seen += n
                if seen - n < PROBE:
                    probe[token] = tf
                if seen >= k:
                    # So many documents have this much from this token alone.
                    reached = max(reached, weights[token][0] * tf)
                    if seen >= PROBE:
                        break
        if sharpen:
            best = self._scored(weights, probe).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("s"), F.count("*").alias("n")).first()
            if best["n"] >= k:
                reached = max(reached, best["s"])
        total = math.fsum(w * tf for w, tf in weights.values())
        # Scores are rounded to 6 digits.
        return {t: (reached - 1e-5 - (total - w * tf)) / w for t, (w, tf) in weights.items()}

    def scores(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """(query, doc, score) for a table of queries, by a join on the tokens; partitions of tokens that none has are pruned where the plan is dynamic."""
        buckets = self._read("meta").first()["buckets"]
        q = lexical.terms(queries, key, text).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).withColumnRenamed("tf", "q_tf")
        q = q.join(self._read("tokens").select("bucket", "token", "idf"), ["bucket", "token"])
        met = self._read("postings").join(q, ["bucket", "token"]).select(key, F.explode("docs").alias("doc"), (F.col("q_tf") * F.col("tf") * F.col("idf")).alias("part"))
        return met.groupBy(key, "doc").agg(F.round(F.sum("part"), 6).alias("score"))
