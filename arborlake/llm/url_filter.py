"""URL filter: all glob rules as one multiword Shift-And automaton.

The rules' literal characters are laid out as bits of a few 64-bit words. For a
batch of URLs, one step over a character position advances every pattern of
every URL at once: D = ((D << 1 | starts) & mask[char]) | (D & stars). A bit
that waits at a '*' stays set whatever comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest fitting rule wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Where no rule fits: block what one of these globs matches (over `.host?path`), allow the rest.
BLOCK_GLOBS = ["*.spam-*?*", "*cheap-pills*?*", "*casino*?*", "?*"]
BLOCK_ROWS = 4096


class ShiftAnd:
    """Glob patterns ('*' is the only wildcard) over whole strings of bytes."""

    def __init__(self, globs: list[str]):
        bits: list[tuple[int, bool]] = []  # per literal byte: its value, whether a '*' follows it
        self.first, self.last, self.free_start, self.empty = [], [], [], []
        for g in globs:
            raw = g.encode()
            lead = raw.startswith(b"*")
            literal = [b for b in raw if b != 42]
            begin = len(bits)
            stars = [False] * len(literal)
            k = -1
            for b in raw:
                if b != 42:
                    k += 1
                elif k >= 0:
                    stars[k] = True
            bits += list(zip(literal, stars, strict=True))
            self.first.append(begin)
            self.last.append(len(bits) - 1)
            self.free_start.append(lead)
            self.empty.append(not literal)
        self.n_words = max(1, -(-len(bits) // 64))
        as_words = lambda idx: self._pack(idx)
        self.mask = np.stack([as_words([i for i, (b, _) in enumerate(bits) if b == c]) for c in range(256)])
        self.star = as_words([i for i, (_, s) in enumerate(bits) if s])
        live = [f for f, e in zip(self.first, self.empty, strict=True) if not e]
        free = [f for f, e, s in zip(self.first, self.empty, self.free_start, strict=True) if s and not e]
        self.begin, self.again = as_words(live), as_words(free)
        self.entry = ~as_words(live)  # a bit shifted in from the pattern before does not count
        self.globs = globs

    def _pack(self, idx: list[int]) -> np.ndarray:
        out = np.zeros(self.n_words, np.uint64)
        for i in idx:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def match(self, strings: list[bytes]) -> np.ndarray:
        """bool[strings, globs]"""
        out = np.zeros((len(strings), len(self.globs)), bool)
        order = np.argsort([len(s) for s in strings], kind="stable")
        for lo in range(0, len(order), BLOCK_ROWS):
            idx = order[lo : lo + BLOCK_ROWS]
            out[idx] = self._block([strings[i] for i in idx])
        return out

    def _block(self, strings: list[bytes]) -> np.ndarray:
        sizes = np.array([len(s) for s in strings])
        flat = np.frombuffer(b"".join(strings), np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state = np.zeros((len(strings), self.n_words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for pos in range(int(sizes.max(initial=0))):
            k = int(np.searchsorted(sizes, pos, "right"))  # sorted: rows before k have ended
            d = state[k:]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved = (moved & self.entry) | (self.begin if pos == 0 else self.again)
            state[k:] = (moved & self.mask[flat[at[k:] + pos]]) | (d & self.star)
        out = np.zeros((len(strings), len(self.globs)), bool)
        for g, last in enumerate(self.last):
            if self.empty[g]:
                out[:, g] = (sizes == 0) | ("*" in self.globs[g])
            else:
                out[:, g] = (state[:, last // 64] >> np.uint64(last % 64)) & one > 0
        return out


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, block_globs: list[str] = BLOCK_GLOBS) -> DataFrame:
    """One row per page: id, host, path, rule (longest that fits, else null), verdict.

    Null url or none with '://': host and path empty, no rule, blocked by the
    glob `?*` (nothing to fetch). Repeated rows are judged alike; ties in length
    go to the rule listed first.
    """
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    # '?' cannot occur in a host or a path, so it marks their border once; a rule's own '*' would be literal there.
    globs = [f"*.{h}?{p}*" for _, h, p in by_length] + list(block_globs)
    machine = ShiftAnd(globs)
    n = len(by_length)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = machine.match([(f".{h}" if h else "").encode() + b"?" + p.encode() for h, p in zip(pdf["host"], pdf["path"], strict=True)])
            any_rule = hit[:, :n].any(axis=1)
            best = hit[:, :n].argmax(axis=1)
            verdict = np.where(hit[:, n:].any(axis=1), "block", "allow").astype(object)
            names = np.array([h + p for _, h, p in by_length] or [""], object)
            said = np.array([v for v, _, _ in by_length] or [""], object)
            verdict[any_rule] = said[best[any_rule]]
            yield pd.DataFrame({id_col: pdf[id_col], "host": pdf["host"], "path": pdf["path"], "rule": np.where(any_rule, names[best], None), "verdict": verdict})

    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return urls.mapInPandas(judge, f"{id_col} {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host = '' OR contains('.' || host, '.spam-') OR contains(host, 'cheap-pills') OR contains(host, 'casino') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""
