"""Text functions, all as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:[._+-][a-z0-9]+)*"
# The lexical stop words.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "both", "by", "can", "does", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "used", "using",
    "what", "when", "where", "which", "with",
]
# The marks that may follow a sentence's last point.
CLOSING = "[\"'”’)\\]}]"


def present(c: Column) -> Column:
    """Neither null nor blank; else null. Empty strings count as missing in every fallback chain."""
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def token_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, token) of each lexical token: exploded first, so that the filters run in generated code."""
    every = df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("token"))
    return every.where((F.length("token") > 1) & ~F.col("token").isin(STOP_WORDS))


def tokens(c: Column) -> Column:
    """Lexical tokens: lower case, longer than one character, no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def clip(c: Column, limit: int) -> Column:
    """At most limit characters, cut back to the last space, with an ellipsis where cut."""
    text = collapse(c)
    cut = F.substring(text, 1, limit)
    back = F.regexp_replace(F.regexp_extract(cut, r"^(.*) [^ ]*$", 1), "[ ,;:]+$", "")
    hard = F.regexp_replace(cut, "[ ,;:]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(back == "", hard).otherwise(back), F.lit("…")))


def clean_page(c: Column) -> Column:
    """NULs dropped, words split by a hyphen at a line's end joined."""
    return F.regexp_replace(F.translate(c, "\x00", ""), r"([A-Za-z0-9_])-[ \t]*\n[ \t]*([A-Za-z0-9_])", "$1$2")


def ends_sentence(c: Column) -> Column:
    return F.rtrim(c).rlike(rf"[.!?]{CLOSING}*$")


def looks_like_prose(c: Column) -> Column:
    """Six words or more, and letters are 55 % of what is visible."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    visible = F.length(F.regexp_replace(c, r"\s", ""))
    words = F.regexp_count(c, F.lit(r"\b[A-Za-z][A-Za-z'-]*\b"))
    return (words >= 6) & (visible > 0) & (letters >= 0.55 * visible)


def clean_topic_text(c: Column) -> Column:
    """Lower case without URLs, e-mail addresses and marks other than . , - :"""
    t = F.regexp_replace(F.lower(c), r"(https?://|www\.)[^ \n\t]+", " ")
    t = F.regexp_replace(t, r"[a-z0-9._+-]+@[a-z0-9._-]+", " ")
    return collapse(F.regexp_replace(t, r"[^a-z0-9.,:\n\t -]", " "))


def clean_notebook_text(c: Column) -> Column:
    """Lower case letters and single spaces."""
    return collapse(F.regexp_replace(F.lower(c), r"[^a-z]+", " "))


def unique_clean(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def clean_optional(c: Column) -> Column:
    """Ordered distinct trimmed strings without null markers, whatever their case and full stops at their end."""
    # The null markers.
    markers = ["", "n/a", "none", "not applicable", "not provided", "not specified", "not stated", "unknown"]
    stripped = F.transform(c, lambda x: F.trim(x))
    return F.array_distinct(F.filter(stripped, lambda x: ~F.regexp_replace(F.lower(x), r"\.+$", "").isin(markers)))


def clean_concepts(c: Column) -> Column:
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: (F.length(x) > 2) & (F.length(x) <= 200) & ~F.lower(x).contains("evidence_quote") & ~F.lower(x).contains("page_num") & ~x.startswith("{") & ~x.startswith("["))
    return F.array_distinct(kept)


def derived_title(c: Column, fallback: str = "Derived implementation idea") -> Column:
    first = F.trim(F.split_part(F.trim(c), F.lit("."), F.lit(1)))
    return F.when(F.length(first) < 3, F.lit(fallback)).otherwise(F.substring(first, 1, 200))


def content_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_.-]+"), F.lit(0)), lambda t: F.length(t) > 2))


def support(statement: Column, quote: Column) -> Column:
    """Share of the statement's content tokens that the quote has (0 without any)."""
    s, q = content_tokens(statement), content_tokens(quote)
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(s, q)) / F.size(s))


def meta_tags(html: Column, prefix: str) -> Column:
    """Contents of <meta name="prefix…" content="…">, in order."""
    return F.regexp_extract_all(html, F.lit(rf'<meta[^>]*name="{prefix}[a-z_]*"[^>]*content="([^"]*)"'), F.lit(1))


def truncated_json(c: Column) -> Column:
    """Whether a JSON answer seems cut: it opens but does not close."""
    t = F.trim(c)
    return t.rlike(r"^[\[{]") & ~t.rlike(r"[\]}]$")


def json_tokens(json: Column) -> Column:
    """Estimated tokens of compact JSON: a quarter of its UTF-8 bytes, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(json) / 4)).cast("long")


def strip_references(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """pages with the text of bibliographies blanked: from a line `References` on, up to a page that starts an appendix.

    A page with such a line keeps what stands before it; a page that ends a
    bibliography stays whole. Pages of one document meet in one window.
    """
    heading = r"(?im)^[ \t]*references[ \t]*$"
    c = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.slice(F.split(c, "\r\n|\r|\n"), 1, 20), lambda x: F.trim(F.regexp_replace(x, r"[\t\f\x0B]", " "))), lambda x: x != "")
    follows = F.exists(
        F.arrays_zip(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))).alias("a"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("b")),
        lambda z: z["a"].rlike(r"^[A-Z](\.\d+)?$") & (z["b"] == F.upper(z["b"])) & F.length(z["b"]).between(3, 100),
    )
    appendix = F.exists(lines, lambda x: F.lower(x).startswith("appendix")) | F.coalesce(follows, F.lit(False))
    marked = pages.withColumns({"h_": c.rlike(heading), "a_": appendix})
    # A page with one of the two settles whether a bibliography goes on after it; a page with both turns that round.
    order = Window.partitionBy(doc).orderBy(page)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.when(F.col("h_") & ~F.col("a_"), 1).when(F.col("a_") & ~F.col("h_"), 0)
    turn = F.when(F.col("h_") & F.col("a_"), 1).otherwise(0)
    marked = marked.withColumns({"s_": settled, "t_": turn}).withColumn("k_", F.sum(F.when(F.col("s_").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turns = F.sum("t_").over(Window.partitionBy(doc, "k_").orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("after_", (F.coalesce(F.last("s_", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + turns) % 2)
    inside = F.coalesce(F.last("after_").over(before), F.lit(0)) == 1
    cut = F.when(inside, F.when(F.col("a_"), F.col(text)).otherwise("")).when(F.col("h_"), F.regexp_replace(F.regexp_extract(c, r"(?is)^(.*?)(?:(?<=\n)|^)[ \t]*references[ \t]*(?:\r?\n.*)?$", 1), r"^\s+|\s+$", "")).otherwise(F.col(text))
    return marked.withColumn(text, cut).select(*pages.columns)


def char_windows(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, n, start, piece): fixed windows of `size` characters, each starting `overlap` before the last one's end."""
    step, length = size - overlap, F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - overlap) / step) - 1).cast("int") * step, F.lit(step))
    rows = df.where(length > 0).select(key, F.col(text).alias("t_"), F.posexplode(starts).alias("n", "start"))
    return rows.select(key, "n", "start", F.expr(f"substring(t_, start + 1, {size})").alias("piece"))


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that makes them small enough and joined again up to the size, with up to `overlap` characters of the piece before."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    held: list[str] = []

    def width(ps: list[str]) -> int:
        return sum(map(len, ps)) + len(sep) * max(0, len(ps) - 1)

    def flush() -> None:
        if piece := sep.join(held).strip():
            out.append(piece)

    for part in parts:
        if len(part) > size and rest:
            flush()
            held.clear()
            out += split_text(part, size, overlap, rest)
            continue
        if held and width([*held, part]) > size:
            flush()
            while held and (width(held) > overlap or width([*held, part]) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def split_recursive(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, n, piece) by split_text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, p) for k, t in zip(pdf[key], pdf[text], strict=True) for i, p in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "n", "piece"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, n int, piece string")


def token_hash(df: DataFrame, token: str, name: str = "index") -> DataFrame:
    """df with the 32-bit index that a token has in stored sparse vectors: a personalised digest, computed per distinct token of a batch."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = {t: int.from_bytes(hashlib.blake2s(t.encode(), digest_size=4, person=b"arxivlex").digest(), "big") for t in pdf[token].dropna().unique()}
            yield pdf.assign(**{name: pdf[token].map(known).astype("Int64")})

    return df.mapInPandas(run, df.select("*", F.lit(None).cast("long").alias(name)).schema)
