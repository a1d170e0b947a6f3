"""Every registered query with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a (tables) -> DataFrame function; tables(name) reads a table of the data set."""

    def register(build: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


from . import q_corpus, q_delta, q_evaluation, q_graph, q_index, q_joins, q_reports, q_research, q_retrieval, q_series, q_summary, q_text  # noqa: E402, F401
