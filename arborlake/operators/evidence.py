"""Evidence: sentence spans, verification spans, quotes found in a page, chunks of pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Abbreviations whose full stop ends no sentence, and closing marks.
ABBREVIATIONS = {"al", "approx", "dr", "e.g", "eq", "eqs", "etc", "fig", "figs", "i.e", "mr", "mrs", "ms", "no", "prof", "ref", "refs", "sec", "secs", "vs"}
CLOSING = "\"'”’)]}"
_STOP = re.compile(rf"[.!?](?=$|\s|[{re.escape(CLOSING)}])")
_LAST_WORD = re.compile(r"[A-Za-z][A-Za-z.]*$")
_WORD = re.compile(r"\b\w+\b")


def readable(text: str | None) -> str:
    return " ".join((text or "").split())


def sentences(text: str) -> list[tuple[int, int]]:
    """Trimmed (start, end) of each sentence; abbreviations, initials and decimals do not end one."""
    out, begin = [], 0

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        b -= len(piece) - len(piece.rstrip())
        if b > a:
            out.append((a, b))

    for stop in _STOP.finditer(text):
        at = stop.start()
        if at < begin:
            continue
        if text[at] == ".":
            word = _LAST_WORD.search(text, max(0, at - 40), at)
            w = word.group().casefold().rstrip(".") if word else ""
            if w in ABBREVIATIONS or (len(w) == 1 and w.isascii()):
                continue
        end = at + 1
        while end < len(text) and text[end] in CLOSING:
            end += 1
        add(begin, end)
        begin = end
    add(begin, len(text))
    return out


def terminal(text: str) -> bool:
    return text.rstrip().rstrip(CLOSING)[-1:] in tuple(".!?")


def prose(text: str) -> bool:
    visible = [c for c in text if not c.isspace()]
    return len(re.findall(r"\b[A-Za-z][A-Za-z'-]*\b", text)) >= 6 and sum(c.isalpha() for c in visible) >= 0.55 * len(visible) > 0


def verification_span(quote: str | None, page: str | None, around: int = 1, limit: int = 1200) -> tuple[str, bool]:
    """(readable span, truncated): the quote widened to its sentences and up to `around` on either side within limit."""
    source, text = readable(quote), readable(page)
    at = text.casefold().find(source.casefold()) if source and text else -1
    if at < 0:
        return source, True
    spans = sentences(text)
    hit = [i for i, (a, b) in enumerate(spans) if a < at + len(source) and b > at]
    if not hit:
        return source, True
    first, last = hit[0], hit[-1]
    core = text[spans[first][0] : spans[last][1]]
    if len(core) > limit or not terminal(core) or not prose(core):
        return source[:limit].rstrip(), True
    for _ in range(around):
        if first and spans[last][1] - spans[first - 1][0] <= limit:
            first -= 1
        if last + 1 < len(spans) and spans[last + 1][1] - spans[first][0] <= limit:
            last += 1
    wide = text[spans[first][0] : spans[last][1]]
    return wide, not (source.casefold() in wide.casefold() and terminal(wide))


def _shared_tokens(want: list[str], have: list[str]) -> np.ndarray:
    """For each window of len(want) tokens of have, how many it has in common with want, as multisets."""
    n = len(want)
    total = np.zeros(max(0, len(have) - n + 1), np.int64)
    for token, times in Counter(want).items():
        seen = np.concatenate([[0], np.cumsum([t == token for t in have])])
        total += np.minimum(seen[n:] - seen[:-n], times)
    return total


def find_quote(quote: str | None, page: str | None) -> str | None:
    """The page's own text for a quote: the quote itself, or the window of as many tokens that is most like it.

    Quotes of under 8 readable characters are not sought, those of under 6
    tokens only verbatim. A window is alike from a matching ratio of 0.9 on, for
    20 tokens or more from 0.86; of equally good ones the first counts. The
    ratio cannot exceed the share of common tokens, so windows are aligned in
    the order of that share, until it falls below the best ratio.
    """
    wanted, page = (quote or "").strip(), page or ""
    if len(readable(wanted)) < 8 or wanted in page:
        return wanted if len(readable(wanted)) >= 8 else None
    want = [m.group().casefold() for m in _WORD.finditer(wanted)]
    marks = [(m.start(), m.end(), m.group().casefold()) for m in _WORD.finditer(page)]
    n = len(want)
    if not 6 <= n <= len(marks):
        return None
    have = [w for _, _, w in marks]
    share = _shared_tokens(want, have) / n
    best = (0.9 if n < 20 else 0.86, 1)
    for i in np.argsort(-share, kind="stable").tolist():
        if share[i] < best[0]:
            break
        ratio = SequenceMatcher(None, want, have[i : i + n]).ratio()
        best = max(best, (ratio, -i))
    return None if best[1] > 0 else page[marks[-best[1]][0] : marks[n - 1 - best[1]][1]].strip()


def verify(claims: DataFrame, key: list[str], quote: str, page: str) -> DataFrame:
    """key, found quote (null if the page does not have it), its readable span and whether that is truncated."""
    types = dict(claims.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [find_quote(q, p) for q, p in zip(pdf[quote], pdf[page], strict=True)]
            spans = [verification_span(f, p) if f else ("", True) for f, p in zip(found, pdf[page], strict=True)]
            out = pdf[key].reset_index(drop=True)
            yield out.assign(found=found, span=[s for s, _ in spans], truncated=[t for _, t in spans])

    return claims.select(*key, quote, page).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in key) + ", found string, span string, truncated boolean")


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence number, start, end, sentence)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(pdf[key], pdf[text].fillna(""), strict=True) for i, (a, b) in enumerate(sentences(t))]
            yield pd.DataFrame(rows, columns=[key, "n", "start", "end", "sentence"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, n int, start int, end int, sentence string")


def chunk_pages(pages: DataFrame, doc: str, number: str, text: str, limit: int) -> DataFrame:
    """(doc, chunk, first page, last page, chars): pages packed in order up to limit characters, never split."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, size = [], 0
        for page, t in pdf.sort_values(number)[[number, text]].itertuples(index=False):
            n = len(t or "")
            if not rows or size + n > limit:
                rows.append([pdf[doc].iloc[0], len(rows), page, page, n])
                size = n
            else:
                rows[-1][3], rows[-1][4] = page, rows[-1][4] + n
                size += n
        return pd.DataFrame(rows, columns=[doc, "chunk", "first_page", "last_page", "chars"])

    types = dict(pages.dtypes)
    return pages.select(doc, number, text).groupBy(doc).applyInPandas(run, f"{doc} {types[doc]}, chunk int, first_page {types[number]}, last_page {types[number]}, chars long")
