"""Calls of outside models, as functions that are passed in: embeddings, structured answers, prompts per paper, workflows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import STOP_WORDS, TOKEN


class ModelError(RuntimeError):
    pass


def hashed_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """The offline default: 1 + ln(count) of each token at a signed place given by its digest, scaled to length 1."""
    import re

    out = []
    for text in texts:
        v = np.zeros(dims)
        found, counts = re.findall(TOKEN, text.lower()), {}
        for t in found:
            if len(t) > 1 and t not in STOP_WORDS:
                counts[t] = counts.get(t, 0) + 1
        for t, n in counts.items():
            d = int.from_bytes(hashlib.blake2s(t.encode(), digest_size=8).digest(), "big")
            v[d % dims] += (1 if d >> 63 else -1) * (1 + np.log(n))
        length = np.linalg.norm(v)
        out.append((v / length if length else v).tolist())
    return out


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]] = hashed_embedding, prefix: str = "", batch: int = 256) -> DataFrame:
    """(key, embedding): each text with its prefix through the model, in batches; as many vectors as texts, none of them empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float]] = []
            texts = [prefix + (t or "") for t in pdf[text]]
            for a in range(0, len(texts), batch):
                got = model(texts[a : a + batch])
                if len(got) != len(texts[a : a + batch]):
                    raise ModelError(f"{len(got)} vectors for {len(texts[a : a + batch])} texts")
                if any(not len(v) for v in got):
                    raise ModelError("an embedding is empty")
                vectors += got
            yield pd.DataFrame({key: pdf[key], "embedding": [list(map(float, v)) for v in vectors]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def structured(call: Callable[[str, int], tuple[str, bool]], parse: Callable[[str], Any], prompt: str, tokens: int = 1024, attempts: int = 2) -> Any:
    """A parsed answer. call(prompt, tokens) returns the text and whether it was cut; after a cut or unreadable one, another attempt, with twice the tokens if it was cut."""
    error: Exception | None = None
    for _ in range(attempts):
        text, cut = call(prompt, tokens)
        try:
            return parse(text)
        except ValueError as e:
            error = e
        if cut:
            tokens *= 2
    raise ModelError(f"no usable answer in {attempts} attempts: {error}")


def prompt_map(papers: DataFrame, key: str, columns: list[str], tasks: dict[str, Callable[[dict], str]], call: Callable[[str], str]) -> DataFrame:
    """(key, task, answer, error): every task's prompt for every paper, on the executors; a call that fails gives its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                for name, prompt in tasks.items():
                    try:
                        rows.append((r[key], name, call(prompt(r)), None))
                    except Exception as e:  # told in its own column
                        rows.append((r[key], name, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[key, "task", "answer", "error"])

    kind = dict(papers.dtypes)[key]
    return papers.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} {kind}, task string, answer string, error string")


def workflow(paper: Any, steps: list[tuple[str, Callable[[Any], Any]]]) -> dict:
    """Run the steps of one paper in order, each on what the one before returned; stops at the first that fails."""
    done: list[str] = []
    for name, step in steps:
        try:
            paper = step(paper)
        except Exception as e:
            return {"status": "failed", "step": name, "error": f"{type(e).__name__}: {e}"[:300], "done": done}
        done.append(name)
    return {"status": "complete", "done": done, "result": paper}


def batch_workflow(papers: list, steps: list[tuple[str, Callable[[Any], Any]]], stop_after: int | None = None) -> dict:
    """A bounded selection of papers, one after another; failures are collected, and end the batch after `stop_after` of them."""
    results, failures = [], []
    for p in papers:
        r = workflow(p, steps)
        results.append(r["status"])
        if r["status"] == "failed":
            failures.append({"paper": p, "step": r["step"], "error": r["error"]})
            if stop_after is not None and len(failures) >= stop_after:
                break
    return {"processed": len(results), "complete": results.count("complete"), "failures": failures}
