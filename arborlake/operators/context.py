"""Context packages: the items of a paper that fit a token budget, always with their evidence."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame

# The profiles' token budgets.
PROFILES = {"brief": 1500, "standard": 4000, "deep": 8000}


def estimate(document: dict) -> int:
    """A quarter of the compact, sorted JSON's UTF-8 bytes, rounded up."""
    return max(1, math.ceil(len(json.dumps(document, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()) / 4))


def settled(document: dict) -> dict:
    """document with its own estimate inside: repeated, since the number's digits count too."""
    tokens = 0
    for _ in range(4):
        document = document | {"estimated_tokens": tokens}
        now = estimate(document)
        if now == tokens:
            break
        tokens = now
    return document | {"estimated_tokens": tokens}


def package(head: dict, items: list[dict], evidence: dict[str, str], budget: int) -> dict:
    """The longest prefix of items (in their fixed order) that fits with all evidence it cites.

    The head and its evidence are required; if they alone are too large, a
    ValueError names the least budget. An unknown evidence id is an error.
    """
    cited = set(head["evidence_ids"]).union(*[i["evidence_ids"] for i in items]) if items else set(head["evidence_ids"])
    if unknown := sorted(cited - evidence.keys()):
        raise ValueError("unknown evidence: " + ", ".join(unknown))

    def build(n: int) -> dict:
        ids = set(head["evidence_ids"]).union(*[i["evidence_ids"] for i in items[:n]]) if n else set(head["evidence_ids"])
        return settled({"head": head, "items": items[:n], "evidence": {k: evidence[k] for k in sorted(ids)}, "omitted": len(items) - n})

    best = build(0)
    if best["estimated_tokens"] > budget:
        raise ValueError(f"budget {budget} is below the least, {best['estimated_tokens']}")
    for n in range(1, len(items) + 1):
        nxt = build(n)
        if nxt["estimated_tokens"] > budget:
            break
        best = nxt
    return best


def package_keys(package: dict) -> set[str]:
    """What a package holds, as keys that stay the same between budgets."""
    return {"head:" + package["head"]["statement"]} | {f"{i.get('field', 'item')}:{i['statement']}" for i in package["items"]}


def package_checks(head: dict, items: list[dict], evidence: dict[str, str], budgets: dict[str, int] = PROFILES) -> list[dict]:
    """Per profile, smallest budget first: tokens, units and evidence kept, and whether the package keeps its promises."""
    out: list[dict] = []
    before: set[str] = set()
    for profile, budget in sorted(budgets.items(), key=lambda x: x[1]):
        p = package(head, items, evidence, budget)
        keys = package_keys(p)
        cited = set(p["head"]["evidence_ids"]).union(*[i["evidence_ids"] for i in p["items"]])
        out.append({
            "profile": profile, "tokens": p["estimated_tokens"], "units": len(p["items"]), "evidence": len(p["evidence"]), "budget_compliant": p["estimated_tokens"] <= budget, "evidence_closed": cited == set(p["evidence"]),
            "deterministic": p == package(head, items, evidence, budget), "monotonic": before <= keys,
        })
        before = keys
    return out


def pack_papers(items: DataFrame, paper: str, order: str, text: str, budget: int) -> DataFrame:
    """(paper, items, tokens): per paper, its first row as head and the others as items, each its own evidence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order)
        texts = rows[text].fillna("").tolist()
        head = {"statement": texts[0][:200], "evidence_ids": ["e0"]}
        evidence = {f"e{i}": t[:120] for i, t in enumerate(texts)}
        try:
            out = package(head, [{"statement": t, "evidence_ids": [f"e{i + 1}"]} for i, t in enumerate(texts[1:])], evidence, budget)
        except ValueError:
            return pd.DataFrame({paper: [rows[paper].iloc[0]], "items": [-1], "tokens": [0]})
        return pd.DataFrame({paper: [rows[paper].iloc[0]], "items": [len(out["items"])], "tokens": [out["estimated_tokens"]]})

    return items.select(paper, order, text).groupBy(paper).applyInPandas(run, f"{paper} {dict(items.dtypes)[paper]}, items long, tokens long")


def _clipped(abstract: str, limit: int) -> str:
    """At most limit characters with the ellipsis, back to the last space."""
    return abstract[: limit - 1].rsplit(" ", 1)[0] + "…"


def fit_response(response: dict, budget: int, clip: int = 800) -> dict:
    """Shrink a search response of a few dozen papers to the budget, one change at a time, counts and estimate included.

    Each step takes the last paper that allows it: drop the abstract of a paper
    with evidence (tier 1); drop its last item, if it has several; clip an
    abstract above `clip` characters. Then whole papers go (one stays), and then
    the first abstract that is left.
    """
    papers = [dict(p, items=list(p.get("items") or [])) for p in response["papers"]]
    found = len(papers)

    def document() -> dict:
        backed = sum(p.get("tier") == 1 for p in papers)
        cut = found > len(papers) or any(p.get("abstract_truncated") for p in papers)
        counts = {"returned_papers": len(papers), "evidence_backed_papers": backed, "metadata_only_papers": len(papers) - backed}
        budgeted = {"requested_tokens": budget, "returned_papers": len(papers), "omitted_papers": found - len(papers), "truncated": cut}
        state = {"papers": papers, "coverage": response.get("coverage", {}) | counts, "budget": budgeted, "result_status": "matches" if papers else "no_match"}
        return settled({k: v for k, v in response.items() if k not in state} | state)

    def drop(p: dict) -> None:
        p.update(abstract=None, abstract_truncated=True)

    steps = [
        (lambda p: p.get("tier") == 1 and p.get("abstract"), drop),
        (lambda p: len(p["items"]) > 1, lambda p: p["items"].pop()),
        (lambda p: len(p.get("abstract") or "") > clip, lambda p: p.update(abstract=_clipped(p["abstract"], clip), abstract_truncated=True)),
    ]
    while (now := document())["estimated_tokens"] > budget:
        for may, change in steps:
            if p := next((p for p in reversed(papers) if may(p)), None):
                change(p)
                break
        else:
            if len(papers) > 1:
                papers.pop()
            elif p := next((p for p in papers if p.get("abstract")), None):
                drop(p)
            else:
                now["budget"]["truncated"] = True
                break
    return now
