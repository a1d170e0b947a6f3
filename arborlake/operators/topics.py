"""Topics: a model over token counts, its names and hierarchy, reports with a threshold, quality."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut

UNCATEGORISED = -1


@dataclass
class TopicModel:
    """Hashed term weights and k-means centroids, with the words that name each topic."""

    pipeline: object
    centers: np.ndarray
    words: dict[int, list[str]]

    def name(self, topic: int) -> str:
        return "_".join([str(topic), *self.words.get(topic, [])])


def fit(docs: DataFrame, key: str, text: str, topics: int, features: int = 1 << 14, seed: int = 42, words: int = 4) -> TopicModel:
    """Fit on all of docs: hashed tf-idf, normalised, k-means; a topic's words are those most frequent in it and rare in the others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    # Written once, as frequencies, centroids and names each read them.
    bags = cut(_bags(docs, key, text))
    stages = [HashingTF(inputCol="bag", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="w"), Normalizer(inputCol="w", outputCol="features"), KMeans(k=topics, seed=seed, featuresCol="features", predictionCol="topic")]
    model = Pipeline(stages=stages).fit(bags)
    centers = np.array([c for c in model.stages[-1].clusterCenters()])
    return TopicModel(model, centers, named(assign_ids(bags, model), words))


def _bags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bag) of each row: its tokens, made where the row lies."""
    return docs.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("bag"))


def assign_ids(bags: DataFrame, model: object) -> DataFrame:
    return model.transform(bags).select("topic", F.explode("bag").alias("token"))


def named(tokens: DataFrame, words: int) -> dict[int, list[str]]:
    """(topic, token) rows -> the best words of each topic by class-based tf-idf. At most topics x words rows come to the driver."""
    w = class_weights(tokens)
    best = w.groupBy("topic").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token"))), 1, words).alias("b"))
    return {r["topic"]: [x["token"] for x in r["b"]] for r in best.collect()}


def class_weights(tokens: DataFrame) -> DataFrame:
    """(topic, token, weight): share in the topic times ln(1 + mean topic size / frequency over all topics)."""
    n = cut(tokens.groupBy("topic", "token").agg(F.count("*").alias("n")))
    size = n.groupBy("topic").agg(F.sum("n").alias("size"))
    total = n.groupBy("token").agg(F.sum("n").alias("f"))
    mean = size.agg(F.avg("size").alias("mean"))
    j = n.join(F.broadcast(size), "topic").join(total, "token").join(F.broadcast(mean))
    return j.select("topic", "token", F.round(F.col("n") / F.col("size") * F.ln(1 + F.col("mean") / F.col("f")), 9).alias("weight"))


def classify(docs: DataFrame, key: str, text: str, model: TopicModel) -> DataFrame:
    """(key, topic, probability): the nearest centroid, and its share of all centroids' similarity. Texts without tokens are uncategorised."""
    from pyspark.ml.functions import vector_to_array

    bags = _bags(docs, key, text)
    rows = model.pipeline.transform(bags).select(key, "topic", F.size("bag").alias("n"), vector_to_array("features").alias("f"))
    norms = np.linalg.norm(model.centers, axis=1)
    centers, spark = model.centers / np.where(norms > 0, norms, 1)[:, None], docs.sparkSession
    shared = spark.sparkContext.broadcast(centers)

    def score(batches):
        for pdf in batches:
            s = np.maximum(np.stack(pdf["f"].to_numpy()) @ shared.value.T, 0) if len(pdf) else np.zeros((0, 1))
            p = s[np.arange(len(pdf)), pdf["topic"].to_numpy()] / np.where(s.sum(axis=1) > 0, s.sum(axis=1), 1)
            out = pdf[[key, "topic"]].assign(probability=np.round(p, 6))
            out.loc[pdf["n"].to_numpy() == 0, ["topic", "probability"]] = [UNCATEGORISED, 0.0]
            yield out.astype({"topic": "int32"})

    return rows.mapInPandas(score, f"{key} {dict(docs.dtypes)[key]}, topic int, probability double")


def hierarchy(centers: np.ndarray, documents: int) -> list[int]:
    """The reduced topic of each topic: the two most alike are merged until max(5, min(30, sqrt(n / 2))) are left."""
    target = max(5, min(30, int(math.sqrt(documents / 2))))
    groups = [[i] for i in range(len(centers))]
    while len(groups) > target:
        means = np.array([centers[g].mean(axis=0) for g in groups])
        norms = np.linalg.norm(means, axis=1)
        unit = means / np.where(norms > 0, norms, 1)[:, None]
        alike = unit @ unit.T
        np.fill_diagonal(alike, -2)
        i, j = sorted(divmod(int(alike.argmax()), len(groups)))
        groups[i] += groups.pop(j)
    out = [0] * len(centers)
    for n, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = n
    return out


def primary(topics: Column, probabilities: Column) -> Column:
    """struct(topic, probability, mean): the first of a document's topics, -1 and 0 where it has none, and the mean probability."""
    n = F.coalesce(F.size(probabilities), F.lit(0))
    mean = F.when(n > 0, F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return F.struct(F.coalesce(F.get(topics, F.lit(0)), F.lit(UNCATEGORISED)).alias("topic"), F.coalesce(F.get(probabilities, F.lit(0)), F.lit(0.0)).alias("probability"), F.round(mean, 6).alias("mean"))


def report(assigned: DataFrame, least: float) -> DataFrame:
    """(topic, n, mean_probability): assignments of that probability at least; all others count as uncategorised."""
    sure = F.col("probability") >= least
    topic = F.when(sure, F.col("topic")).otherwise(UNCATEGORISED)
    return assigned.groupBy(topic.alias("topic")).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability"))


def quality(assigned: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: mean probability, share above one half, and the mean share of a topic's tokens that its ten most frequent ones make up."""
    top = tokens.groupBy("topic", "token").agg(F.count("*").alias("n")).groupBy("topic").agg(F.sum("n").alias("all"), F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 10).alias("best"))
    focus = top.agg(F.round(F.avg(F.aggregate("best", F.lit(0).cast("long"), lambda a, x: a + x) / F.col("all")), 6).alias("coherence"))
    p = assigned.agg(F.round(F.avg("probability"), 6).alias("mean_probability"), F.round(F.count_if(F.col("probability") > 0.5) / F.count("*"), 6).alias("confident"))
    return p.join(focus)


def classify_and_report(docs: DataFrame, key: str, text: str, topics: int, least_words: int = 20, least: float = 0.0) -> DataFrame:
    """Drop texts of up to `least_words` words, fit, classify, and report by topic with its name, most frequent first."""
    long = docs.where(F.size(F.split(F.trim(text), r"\s+")) > least_words)
    model = fit(long, key, text, topics)
    names = docs.sparkSession.createDataFrame([(t, model.name(t)) for t in [UNCATEGORISED, *range(topics)]], "topic int, name string")
    return report(classify(long, key, text, model), least).join(F.broadcast(names), "topic").orderBy(F.desc("n"), "topic")
