"""Paper analyses as nested rows: trusted evidence, catalog and public forms, index points, lookups, repair.

An analysis has paper_id, analysis_id, document_hash, title, generated_at,
is_current, tldr struct<statement, evidence_ids>, claims array<struct<field,
statement, evidence_ids>>, ideas array<struct<title, description, agent_use,
expected_benefit, risks, evidence_ids>>, concepts and tags array<string>, and
evidence array<struct<evidence_id, page, quote, section, truncated>>.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import uuid5
from ..functions.text import clean_optional, present
from .evidence import verification_span

# The claim fields in their order, the order in which a claim may stand in for a summary, and the namespace of point ids.
CLAIM_FIELDS = ["problem", "contributions", "methods", "results", "limitations"]
FALLBACK_FIELDS = ["contributions", "results", "methods", "problem"]
NAMESPACE = "d2e115ed80dd47e4a87520aad852ad20"


def referenced() -> Column:
    """All evidence ids that the summary, claims and ideas cite, distinct."""
    of = lambda items: F.flatten(F.transform(items, lambda i: i["evidence_ids"]))
    return F.array_distinct(F.concat(F.col("tldr.evidence_ids"), of("claims"), of("ideas")))


def trusted(analyses: DataFrame) -> DataFrame:
    """Without truncated evidence and what only it supports; `error` says why an analysis cannot be used, else null."""
    known = F.transform("evidence", lambda e: e["evidence_id"])
    whole = F.filter("evidence", lambda e: ~e["truncated"])
    a = analyses.withColumns({"missing_": F.array_sort(F.array_except(referenced(), known)), "whole_": whole, "ids_": F.transform(whole, lambda e: e["evidence_id"])})

    def supported(item: Column) -> Column:
        return F.filter(item["evidence_ids"], lambda i: F.array_contains("ids_", i))

    def clean(items: str) -> Column:
        return F.filter(F.transform(items, lambda i: i.withField("evidence_ids", supported(i))), lambda i: F.size(i["evidence_ids"]) > 0)

    tldr = F.col("tldr").withField("evidence_ids", supported(F.col("tldr")))
    error = F.when(F.size("missing_") > 0, F.concat(F.lit("unknown evidence: "), F.array_join("missing_", ", "))).when(F.size(tldr["evidence_ids"]) == 0, "no complete evidence for the summary")
    return a.withColumns({"error": error, "claims": clean("claims"), "ideas": clean("ideas"), "tldr": tldr, "evidence": F.col("whole_")}).drop("missing_", "whole_", "ids_")


def of_field(claims: Column, name: str) -> Column:
    return F.filter(claims, lambda c: c["field"] == name)


def content_counts(analyses: DataFrame, key: str = "paper_id") -> DataFrame:
    """Per analysis: cited evidence, claims of each field, ideas, concepts, tags."""
    fields = [F.size(of_field(F.col("claims"), f)).cast("long").alias(f) for f in CLAIM_FIELDS]
    return analyses.select(key, F.size(referenced()).cast("long").alias("evidence"), *fields, *[F.size(c).cast("long").alias(c) for c in ("ideas", "concepts", "tags")])


def catalog(analyses: DataFrame) -> DataFrame:
    """One line per analysis with the sizes of what it holds; the summary is a claim too."""
    return analyses.select(
        "paper_id", "title", "generated_at", F.size("evidence").cast("long").alias("evidence_count"), (1 + F.size("claims")).cast("long").alias("claim_count"), F.size("ideas").cast("long").alias("idea_count")
    )


def public(df: DataFrame, hidden: tuple[str, ...] = ("_id",)) -> DataFrame:
    """(document): each row as JSON without hidden columns, times in ISO form; null fields stay."""
    shown = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in hidden])
    return df.select(F.to_json(shown, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}).alias("document"))


def find_evidence(analyses: DataFrame, ids: DataFrame) -> DataFrame:
    """Per wanted evidence_id, the evidence and paper of the latest current analysis that has it."""
    rows = analyses.where("is_current").select("paper_id", "generated_at", F.explode("evidence").alias("e")).select("paper_id", "generated_at", "e.*")
    rows = rows.join(ids.select("evidence_id").distinct(), "evidence_id")
    return rows.groupBy("evidence_id").agg(F.max_by(F.struct("paper_id", "page", "quote", "truncated"), F.struct("generated_at", "paper_id", "page", "quote")).alias("v")).select("evidence_id", "v.*")


def normal_idea(idea: Column) -> Column:
    """Trimmed texts, at most 10 stated risks, at most 12 distinct evidence ids."""
    out = idea
    for name in ("title", "description", "agent_use", "expected_benefit"):
        out = out.withField(name, F.trim(idea[name]))
    return out.withField("risks", F.slice(clean_optional(idea["risks"]), 1, 10)).withField("evidence_ids", F.slice(F.array_distinct(idea["evidence_ids"]), 1, 12))


def idea_text(idea: Column) -> Column:
    """The one text that stands for an idea: its description, else its use, else its title."""
    return F.coalesce(present(idea["description"]), present(idea["agent_use"]), F.trim(idea["title"]))


def fallback_summary(claims: Column) -> Column:
    """The first claim of the first field that has one, in FALLBACK_FIELDS' order; null without any."""
    return F.coalesce(*[F.get(of_field(claims, f), F.lit(0)) for f in FALLBACK_FIELDS])


def merged_categories(codes: Column, listed: Column, text: Column) -> Column:
    """The corpus codes, else the paper's list, else the words of a string: trimmed, distinct, in order."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))
    some = lambda c: F.when(F.size(c) > 0, clean(c))
    return F.coalesce(some(codes), some(listed), clean(F.split(F.coalesce(text, F.lit("")), r"\s+")))


def complete_provenance(pages: Column, ids: Column, evidence: Column) -> Column:
    """Whether a hit has pages, ids and evidence, and all its ids among the evidence."""
    have = F.transform(evidence, lambda e: e["evidence_id"])
    return F.coalesce((F.size(pages) > 0) & (F.size(ids) > 0) & (F.size(evidence) > 0) & (F.size(F.array_except(ids, have)) == 0), F.lit(False))


def analysis_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def embedding_text(title: Column, kind: Column, category: Column, text: Column, snippets: Column) -> Column:
    """What is embedded for a point: paper, type, category, text and its quotes by page."""
    quotes = F.array_join(F.transform(snippets, lambda s: F.concat(F.lit("Page "), s["page"].cast("string"), F.lit(": "), s["quote"])), "\n")
    head = F.concat(F.lit("Paper: "), title, F.lit("\nType: "), kind, F.lit("\nCategory: "), category, F.lit("\n"), F.trim(text))
    return F.when(F.size(snippets) > 0, F.concat(head, F.lit("\nSource evidence:\n"), quotes)).otherwise(head)


def index_points(analyses: DataFrame, model: str, version: str | Column = "1") -> DataFrame:
    """One row per evidence, claim and idea that untruncated evidence supports, with a stable id and its embedding text."""
    item = lambda kind, category, text, ids: F.struct(F.lit(kind).alias("kind"), category.alias("category"), text.alias("text"), ids.alias("ids"))
    whole = F.filter("evidence", lambda e: ~e["truncated"])
    items = F.concat(
        F.transform(whole, lambda e: item("evidence", F.coalesce(present(e["section"]), F.lit("source_evidence")), e["quote"], F.array(e["evidence_id"]))),
        F.array(item("claim", F.lit("tldr"), F.col("tldr.statement"), F.col("tldr.evidence_ids"))),
        F.transform("claims", lambda c: item("claim", c["field"], c["statement"], c["evidence_ids"])),
        F.transform(F.transform("ideas", normal_idea), lambda i: item("implementation_idea", F.lit("implementation_idea"), idea_text(i), i["evidence_ids"])),
    )
    key = analysis_key(F.col("paper_id"), F.col("document_hash"), F.lit(model), F.lit(version))
    rows = analyses.select("paper_id", "title", key.alias("analysis_key"), whole.alias("whole"), F.explode(items).alias("i")).select("paper_id", "title", "analysis_key", "whole", "i.kind", "i.category", F.trim("i.text").alias("text"), "i.ids")
    usable = F.array_distinct(F.filter("ids", lambda x: F.exists("whole", lambda e: e["evidence_id"] == x)))
    rows = rows.withColumn("evidence_ids", usable).where(F.size("evidence_ids") > 0)
    rows = rows.withColumn("evidence", F.transform("evidence_ids", lambda x: F.get(F.filter("whole", lambda e: e["evidence_id"] == x), F.lit(0))))
    content = F.sha2(F.concat("text", F.lit("\n"), F.array_join(F.array_sort("evidence_ids"), "\n")), 256)
    identity = F.concat_ws(":", "analysis_key", "kind", "category", content)
    return rows.select(
        "paper_id", "analysis_key", "kind", "category", "text", "evidence_ids", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["page"]))).alias("pages"), "evidence",
        identity.alias("identity"), uuid5(NAMESPACE, identity).alias("point_id"), embedding_text(F.col("title"), F.col("kind"), F.col("category"), F.col("text"), F.col("evidence")).alias("embedding_text"),
    )


def upserted(stored: DataFrame, points: DataFrame) -> DataFrame:
    """One row per paper: paper_id, report array<struct<analysis_key, status, points>>, and rows, its points after the upsert (stored's columns but paper_id).

    A key or point id is made of its paper's id, so a paper's points are all that
    meet: they are one group, as its analysis is one row. Sides that lie by
    paper_id already, as grouped analyses do, are not sent again.
    """
    rest = [c for c in stored.columns if c != "paper_id"]
    side = lambda df, name: df.groupBy("paper_id").agg(F.collect_list(F.struct(*rest)).alias(name))
    have, new = side(stored, "old"), side(points, "new")
    named = have.where("paper_id is not null").join(new.where("paper_id is not null"), "paper_id", "full_outer")
    # A null matches no other in a join; the points without a paper are one group here as well.
    none = have.where("paper_id is null").withColumn("at_", F.lit(0)).join(new.where("paper_id is null").select("new", F.lit(0).alias("at_")), "at_", "full_outer")
    j = named.unionByName(none.drop("at_")).select("paper_id", *[F.coalesce(c, F.array()).alias(c) for c in ("old", "new")])
    keyed = lambda items, k: F.size(F.filter(items, lambda x: x["analysis_key"].eqNullSafe(k))).cast("long")
    keys = F.array_distinct(F.transform("new", lambda x: x["analysis_key"]))
    same = lambda k: k.isNotNull() & (keyed("old", k) == keyed("new", k))
    report = F.transform(keys, lambda k: F.struct(k.alias("analysis_key"), F.when(same(k), "unchanged").otherwise("indexed").alias("status"), keyed("new", k).alias("points")))
    j = j.withColumn("report", report)
    j = j.withColumn("indexed_", F.transform(F.filter("report", lambda r: (r["status"] == "indexed") & r["analysis_key"].isNotNull()), lambda r: r["analysis_key"]))
    j = j.withColumn("fresh_", F.filter("new", lambda x: F.array_contains("indexed_", x["analysis_key"])))
    stale = F.filter("old", lambda x: F.col("paper_id").isNotNull() & F.exists("indexed_", lambda k: k != x["analysis_key"]))
    j = j.withColumn("gone_", F.transform(F.concat(stale, "fresh_"), lambda x: x["point_id"]))
    kept = F.filter("old", lambda x: ~F.coalesce(F.array_contains("gone_", x["point_id"]), F.lit(False)))
    return j.select("paper_id", "report", F.concat(kept, "fresh_").alias("rows"))


def upsert_points(stored: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table after the upsert, (paper_id, analysis_key, status, points)).

    An analysis whose key is stored with as many points is unchanged; otherwise
    its points replace those of the same id, and the paper's points under other
    keys go. Papers without new points stay as they are.
    """
    each = upserted(stored, points)
    return each.select("paper_id", F.explode("rows").alias("r")).select("paper_id", "r.*").select(*stored.columns), each.select("paper_id", F.explode("report").alias("r")).select("paper_id", "r.*")


def index_status(report: DataFrame) -> DataFrame:
    """One row: how many analyses per status, all points, and the vector size if there is a single one."""
    return report.agg(
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.when(F.countDistinct("vector_size") == 1, F.max("vector_size")).alias("vector_size"),
    )


def repair(analyses: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per analysis its repaired evidence and ideas, and counters; one row of totals).

    Evidence is widened again from the pages (document_hash, page, text) of the
    very document; analyses whose hash has no pages have `error` and stay as
    they are. Pages meet evidence by a shuffle on (document_hash, page).
    """
    documents = pages.select("document_hash").distinct().withColumn("found_", F.lit(True))
    each = analyses.select("analysis_id", "document_hash", F.posexplode("evidence").alias("at", "e")).select("analysis_id", "document_hash", "at", "e")
    texts = pages.select("document_hash", F.col("page").alias("page_"), F.col("text").alias("page_text"))
    joined = each.join(texts, (each.document_hash == texts.document_hash) & (F.col("e.page") == texts.page_), "left").select("analysis_id", "at", F.col("e.quote").alias("quote"), "page_text")

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [verification_span(q, p) for q, p in zip(pdf["quote"], pdf["page_text"], strict=True)]
            yield pdf[["analysis_id", "at"]].assign(wide=[s for s, _ in spans], cut=[t for _, t in spans])

    kind = dict(analyses.dtypes)["analysis_id"]
    wide = joined.mapInPandas(widen, f"analysis_id {kind}, at int, wide string, cut boolean").groupBy("analysis_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("wide", "cut")))).alias("w"))
    j = analyses.join(documents, "document_hash", "left").join(wide, "analysis_id", "left")
    new = F.transform("evidence", lambda e, i: e.withField("quote", F.element_at("w", i.cast("int"))["wide"]).withField("truncated", F.element_at("w", i.cast("int"))["cut"]))
    ideas = F.transform("ideas", normal_idea)
    ok = F.col("found_").isNotNull()
    j = j.withColumns({"error": F.when(~ok, "document hash mismatch"), "new_": F.when(ok & (F.size("evidence") > 0), new).otherwise(F.col("evidence")), "ideas_": F.when(ok, ideas).otherwise(F.col("ideas"))})
    changed = lambda a, b: F.size(F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"]))).cast("long")
    quotes = F.size(F.filter(F.arrays_zip(F.col("evidence").alias("x"), F.col("new_").alias("y")), lambda z: ~z["x"]["quote"].eqNullSafe(z["y"]["quote"]))).cast("long")
    out = j.select(
        "analysis_id", "error", F.col("new_").alias("evidence"), F.col("ideas_").alias("ideas"), F.size("evidence").cast("long").alias("evidence_total"), quotes.alias("evidence_expanded"),
        F.size(F.filter("new_", lambda e: e["truncated"])).cast("long").alias("evidence_truncated"), F.size("ideas").cast("long").alias("ideas_total"), changed("ideas", "ideas_").alias("ideas_changed"),
    )
    names = ("evidence_total", "evidence_expanded", "evidence_truncated", "ideas_total", "ideas_changed")
    return out, out.where("error is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def collection_status(points: dict[str, DataFrame | None], vector: str = "embedding") -> dict:
    """Availability, points and dimensions of each named table, and the state of all: healthy, degraded or unavailable."""
    rows = []
    for role, df in points.items():
        try:
            r = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first() if df is not None and vector in df.columns else df.agg(F.count("*").alias("n"), F.lit(None).cast("int").alias("d")).first() if df is not None else None
            rows.append({"role": role, "available": r is not None, "points": r["n"] if r else None, "dimensions": r["d"] if r else None})
        except Exception as error:  # a table that cannot be read is what is reported
            rows.append({"role": role, "available": False, "points": None, "dimensions": None, "error": str(error)[:300]})
    up = sum(r["available"] for r in rows)
    return {"status": "healthy" if up == len(rows) else "degraded" if up else "unavailable", "collections": rows}
