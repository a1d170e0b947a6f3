"""The read side as plain functions over tables: what a service or an agent's tools would call.

Each method returns a DataFrame, or a document of bounded size; nothing is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.identity import paper_identity
from .operators import analyses as an
from .operators import context, curated, joins

TOOLS = ["search", "catalog", "analysis", "context_package", "evidence"]
RESOURCES = ["capabilities", "catalog", "analysis"]


class ResearchService:
    """papers: paper_id and metadata. analyses: see operators.analyses. evidence and discovery: retrievers of curated_search."""

    def __init__(self, papers: DataFrame, analyses: DataFrame, evidence, discovery):
        self.papers, self.analyses, self.retrievers = papers, analyses, (evidence, discovery)

    def capabilities(self) -> dict:
        return {"tools": TOOLS, "resources": RESOURCES, "read_only": True, "profiles": dict(context.PROFILES)}

    def current(self) -> DataFrame:
        return joins.newest_per(self.analyses.where("is_current"), "paper_id", F.col("generated_at"), F.col("analysis_id"))

    def catalog(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return an.catalog(self.current()).orderBy(F.desc("generated_at"), "paper_id").offset(offset).limit(limit)

    def analysis(self, paper_id) -> DataFrame:
        """The paper's newest analysis as a public document; no row if it has none."""
        return an.public(self.current().where(F.col("paper_id") == F.lit(paper_id)))

    def resolve(self, raw: DataFrame, column: str) -> DataFrame:
        """raw with the normal id of whatever form of a paper's id stands in the column."""
        return raw.withColumn("identity", paper_identity(F.col(column)))

    def agent_context(self, paper_ids: DataFrame) -> DataFrame:
        """Papers with their newest analysis: papers without one have none, analyses without a paper a stub of it."""
        p = paper_ids.select("paper_id").distinct()
        a = self.current().join(p, "paper_id", "left_semi").select("paper_id", F.struct("analysis_id", "title", "generated_at", "tldr").alias("analysis"))
        known = self.papers.join(p, "paper_id", "left_semi").withColumn("known", F.lit(True))
        return known.join(a, "paper_id", "full_outer").withColumn("known", F.coalesce("known", F.lit(False)))

    def evidence(self, ids: DataFrame) -> DataFrame:
        return an.find_evidence(self.analyses, ids)

    def context_package(self, paper_id, profile: str = "standard", budget: int | None = None) -> dict:
        """One paper's trusted analysis, fitted to a profile's or an explicit budget."""
        rows = an.trusted(self.current().where(F.col("paper_id") == F.lit(paper_id))).limit(1).collect()
        if not rows:
            raise LookupError(f"no analysis of {paper_id}")
        a = rows[0].asDict(recursive=True)
        if a["error"]:
            raise ValueError(a["error"])
        items = [{"field": "ideas", "statement": f"{i['title']}: {i['description']}", "evidence_ids": i["evidence_ids"]} for i in a["ideas"]]
        items += [c for f in an.CLAIM_FIELDS for c in a["claims"] if c["field"] == f]
        items += [{"field": f, "statement": x, "evidence_ids": []} for f in ("concepts", "tags") for x in a[f]]
        quotes = {e["evidence_id"]: f"p. {e['page']}: {e['quote']}" for e in a["evidence"]}
        return {"paper_id": paper_id, "profile": "custom" if budget else profile} | context.package(a["tldr"], items, quotes, budget or context.PROFILES[profile])

    def search(self, limit: int, now: str, budget: int = 8000, **filters) -> dict:
        """The curated response: coverage, and papers fitted to the budget."""
        cover: dict = {}
        top = curated.curated_search(*self.retrievers, self.papers, "paper_id", limit, now, report=cover, **filters)
        return curated.respond(top, "paper_id", budget, cover)
