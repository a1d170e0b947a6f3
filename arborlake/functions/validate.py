"""Record validation as columns: an array of errors, or the first error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

# The feedback taxonomy. Reason -> (group, subject kinds it may have).
REASONS: dict[str, tuple[str, list[str]]] = {
    "off_topic": ("retrieval_defect", ["paper"]),
    "superficial_match": ("retrieval_defect", ["paper"]),
    "not_project_fit": ("project_relative", ["paper", "idea"]),
    "transfer_risk": ("project_relative", ["idea"]),
    "already_covered": ("redundancy", ["paper"]),
    "evidence_unresolvable": ("evidence_analysis_defect", ["evidence"]),
    "evidence_mismatch": ("evidence_analysis_defect", ["evidence"]),
    "evidence_truncated": ("evidence_analysis_defect", ["evidence"]),
    "analysis_gap": ("evidence_analysis_defect", ["paper"]),
    "adopted": ("positive", ["idea"]),
    "trial": ("positive", ["idea"]),
    "useful_context": ("positive", ["paper"]),
    "trial_succeeded": ("outcome_follow_up", ["idea"]),
    "trial_failed": ("outcome_follow_up", ["idea"]),
    "adoption_reverted": ("outcome_follow_up", ["idea"]),
    "coverage_gap": ("corpus_demand", ["topic"]),
}
# The batch contract and its limit.
CONTRACT, CONTRACT_VERSION, MAX_RECORDS = "research-feedback-batch", "1.0", 100
PROJECT_ONLY = ["not_project_fit", "transfer_risk", "already_covered"]
OUTCOMES = ["trial_succeeded", "trial_failed", "adoption_reverted"]
SUBJECT_KINDS = ["paper", "idea", "evidence", "topic"]
VERDICTS = ["ADOPT", "TRIAL", "REJECT", "UNVERIFIED"]


def publication_time(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def valid_publication_date(c: Column, now: Column) -> Column:
    """Readable in one of three forms, from 1990 to now."""
    p = publication_time(c)
    return F.coalesce((p >= F.lit("1990-01-01").cast("timestamp")) & (p <= now), F.lit(False))


def errors(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks that fail (a null condition counts as failed)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks]))


def paper_errors() -> Column:
    """For a record with id, title, summary, published, authors and categories."""
    return errors(
        (present(F.col("id")).isNotNull(), "missing id"),
        (present(F.col("title")).isNotNull(), "missing title"),
        (present(F.col("summary")).isNotNull(), "missing summary"),
        (publication_time(F.col("published")).isNotNull(), "unreadable published"),
        (F.size("authors") > 0, "no authors"),
        (F.size("categories") > 0, "no categories"),
    )


def reason_group(reason: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for r, (g, _) in REASONS.items() for x in (r, g)])
    return F.coalesce(F.try_element_at(lookup, reason), F.lit("unknown"))


def signal_scope(reason: Column) -> Column:
    return F.when(reason.isin(PROJECT_ONLY), "project_only").otherwise("corpus_review")


def _missing(c: Column) -> Column:
    return present(c).isNull()


def _first(bad: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(b, F.lit(False)), F.lit(m)) for b, m in bad])


def envelope_error() -> Column:
    """First error of a batch (contract, contract_version, taxonomy_version, client struct, project struct, records array); null if it can be processed."""
    c = F.col
    return _first([
        (~c("contract").eqNullSafe(F.lit(CONTRACT)), f"contract must be '{CONTRACT}'"),
        (~c("contract_version").eqNullSafe(F.lit(CONTRACT_VERSION)), f"contract_version must be '{CONTRACT_VERSION}'"),
        (_missing(c("taxonomy_version")), "taxonomy_version must be a non-empty string"),
        (c("client").isNull() | _missing(c("client.name")) | _missing(c("client.version")), "client must have a name and a version"),
        (c("project").isNull() | _missing(c("project.id")), "project must have an id"),
        (c("records").isNull() | (F.size("records") == 0), "records must contain at least one record"),
        (F.size("records") > MAX_RECORDS, f"records must contain no more than {MAX_RECORDS} records"),
    ])


def retrieval_error(c: Column) -> Column:
    """Of struct<query, relevance, rank>, where there is one."""
    return F.when(c.isNotNull(), _first([(_missing(c["query"]), "retrieval.query"), (~F.coalesce(c["relevance"].between(0, 1), F.lit(False)), "retrieval.relevance"), (~F.coalesce(c["rank"] >= 1, F.lit(False)), "retrieval.rank")]))


def queries_error(c: Column) -> Column:
    return F.when(F.exists(c, lambda q: _missing(q)), "queries")


def analysis_error(c: Column) -> Column:
    """Of struct<prompt_version, analysis_model, profile>: a part that is there must not be blank."""
    return _first([(c[n].isNotNull() & _missing(c[n]), f"analysis.{n}") for n in ("prompt_version", "analysis_model", "profile")])


def corpus_error(c: Column) -> Column:
    """Of struct<papers, points>: counts that are not negative."""
    return F.when(c.isNotNull(), _first([(~F.coalesce(c[n] >= 0, F.lit(False)), f"corpus.{n}") for n in ("papers", "points")]))


#: Columns of a feedback record that first_record_error reads; those a table lacks count as absent.
OPTIONAL = {
    "point_id": "string", "idea_ref": "string", "evidence_id": "string", "topic": "string", "queries": "array<string>", "retrieval": "struct<query:string,relevance:double,rank:int>",
    "analysis": "struct<prompt_version:string,analysis_model:string,profile:string>", "corpus": "struct<papers:long,points:long>",
}


def first_record_error() -> Column:
    """First error of a feedback record (flat columns, all of OPTIONAL among them), null if it is valid."""
    c = F.col
    kinds = F.create_map(*[x for r, (_, k) in REASONS.items() for x in (F.lit(r), F.array(*[F.lit(v) for v in k]))])
    missing = lambda name: _missing(c(name))
    bad = [
        (missing("feedback_id") | (F.length("feedback_id") > 128), "feedback_id"),
        (F.try_to_timestamp("occurred_at").isNull(), "occurred_at"),
        (~F.coalesce(c("source").isin("agent", "human"), F.lit(False)), "source"),
        ((c("source") == "agent") & (missing("workflow") | missing("run_id")), "agent origin"),
        (missing("stage"), "stage"),
        (c("request_id").isNotNull() & missing("request_id"), "request_id"),
        (missing("reason") | ~c("reason").rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$") | (F.length("reason") > 40), "reason"),
        (~F.coalesce(c("kind").isin(SUBJECT_KINDS), F.lit(False)), "subject kind"),
        (c("kind").isin("paper", "idea", "evidence") & missing("paper_id"), "subject paper"),
        (c("point_id").isNotNull() & (~c("kind").isin("idea", "evidence") | missing("point_id")), "subject point"),
        ((c("kind") == "idea") & missing("idea_ref"), "subject idea"),
        ((c("kind") == "evidence") & missing("evidence_id"), "subject evidence"),
        ((c("kind") == "topic") & missing("topic"), "subject topic"),
        (~F.coalesce(F.array_contains(F.try_element_at(kinds, c("reason")), c("kind")), F.lit(True)), "reason and subject"),
        (c("verdict").isNotNull() & ~c("verdict").isin(VERDICTS), "verdict"),
        (F.length("note") > 2000, "note"),
    ]
    nested = [retrieval_error(c("retrieval")), queries_error(c("queries"))]
    gap = F.when((c("reason") == "coverage_gap") & ~F.coalesce(F.size("queries") > 0, F.lit(False)), "coverage_gap needs queries")
    last = [
        (c("follow_up_of").isNotNull() & missing("follow_up_of"), "follow_up_of"),
        (c("reason").isin(OUTCOMES) & (c("source") != "human"), "outcome needs a human"),
        (c("reason").isin(OUTCOMES) & missing("follow_up_of"), "outcome needs follow_up_of"),
    ]
    return F.coalesce(_first(bad), *nested, gap, analysis_error(c("analysis")), corpus_error(c("corpus")), _first(last))
