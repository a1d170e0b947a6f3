"""Sparse lexical retrieval: term frequencies, corpus idf, weighted dot product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_rows


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): 1 + ln(count) of each lexical token."""
    return token_rows(df, text, key).groupBy(key, "token").agg((1 + F.ln(F.count("*"))).alias("tf"))


def idf(term_table: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(token, df, idf): ln((N - n + .5) / (n + .5) + 1); n_docs has one row and column n."""
    counts = term_table.groupBy("token").agg(F.count("*").alias("df"))
    return counts.join(F.broadcast(n_docs)).select("token", "df", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def sparse_scores(queries: DataFrame, docs: DataFrame, weights: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """(query, doc, score) of term tables: the query's few tokens select postings before anything else is joined."""
    q = queries.select(query_key, "token", F.col("tf").alias("q_tf"))
    q = q.join(weights.select("token", "idf"), "token")
    return docs.join(q, "token").groupBy(query_key, doc_key).agg(F.round(F.sum(F.col("q_tf") * F.col("tf") * F.col("idf")), 6).alias("score"))
