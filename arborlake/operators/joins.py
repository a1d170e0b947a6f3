"""Joins of the metadata kind: hydration, merging of sources, anti-joins, id resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present


def merged(left: str, right: str, left_first: bool = True) -> Column:
    """First non-blank of two sources' versions of a field."""
    a, b = present(F.col(left)), present(F.col(right))
    return F.coalesce(a, b) if left_first else F.coalesce(b, a)


def hydrate_outer(a: DataFrame, b: DataFrame, key: str, fields: dict[str, bool], names: tuple[str, str]) -> DataFrame:
    """Full outer merge of two sources; fields maps a field to whether the first source wins. Adds the list of sources."""
    x = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    y = b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    j = x.join(y, key, "full_outer")
    sources = F.array_compact(F.array(F.when(F.col("in_a"), F.lit(names[0])), F.when(F.col("in_b"), F.lit(names[1]))))
    return j.select(key, *[merged(f"a_{f}", f"b_{f}", first).alias(f) for f, first in fields.items()], sources.alias("sources"))


def hydrate(hits: DataFrame, metadata: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return hits.join(metadata.select(key, *fields), key, "left")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a finished counterpart; a null key never matches, so it stays."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def dangling(items: DataFrame, item_key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """(item, id) references that resolve to nothing."""
    refs = items.select(item_key, F.explode(ids).alias(known_id)).distinct()
    return refs.join(known.select(known_id), known_id, "left_anti")


def resolved_sources(ids: DataFrame, key: str, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per id, the ordered names of the tables that hold it."""
    out = ids.select(key).distinct()
    for name, df in tables:
        out = out.join(df.select(key).distinct().withColumn(f"in_{name}", F.lit(True)), key, "left")
    return out.select(key, F.array_compact(F.array(*[F.when(F.col(f"in_{n}"), F.lit(n)) for n, _ in tables])).alias("sources"))


def newest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that is greatest by the order columns, as max_by: no sort, combined before the shuffle."""
    value = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("v")).select(key, "v.*")


def attach_quotes(items: DataFrame, key: str, ids: str, quotes: DataFrame, quote_id: str, fields: list[str]) -> DataFrame:
    """items with `quotes`: for each id of the array, in its order, struct(id, fields), ids that resolve to nothing left out. Repeated ids repeat."""
    refs = items.select(key, F.posexplode(ids).alias("n_", quote_id))
    found = refs.join(quotes.select(quote_id, *fields), quote_id)
    each = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n_", quote_id, *fields))).alias("q_"))
    out = items.join(each, key, "left")
    empty = F.array().cast(f"array<struct<{quote_id}:{dict(quotes.dtypes)[quote_id]},{','.join(f'{f}:{dict(quotes.dtypes)[f]}' for f in fields)}>>")
    return out.withColumn("quotes", F.coalesce(F.transform("q_", lambda x: F.struct(x[quote_id].alias(quote_id), *[x[f].alias(f) for f in fields])), empty)).drop("q_")


def with_context(papers: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Papers and their newest context: a paper without one has null, a context without a paper a stub (known is false)."""
    c = contexts.select(key, F.struct(*[x for x in contexts.columns if x != key]).alias("context"))
    return papers.withColumn("known", F.lit(True)).join(c, key, "full_outer").withColumn("known", F.coalesce("known", F.lit(False)))


def current_of(analyses: DataFrame, ids: DataFrame, key: str, limit: int, *order: Column) -> DataFrame:
    """The current rows of the listed keys, newest first, at most limit."""
    return analyses.where("is_current").join(ids.select(key).distinct(), key, "left_semi").orderBy(*order).limit(limit)
