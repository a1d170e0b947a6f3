"""Identifiers: normal forms of paper ids and their URLs, keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

# Hosts whose URLs carry ids, and the two id forms.
HOSTS = ["arxiv.org", "www.arxiv.org", "export.arxiv.org"]
ID = r"^(\d{4}\.\d{4,5}|[A-Za-z0-9.-]+/\d{7})(?:v(\d+))?$"
_SITE = HOSTS[0]


def id_candidate(value: Column) -> Column:
    """The id inside a raw id or a URL of a known host; null for anything else."""
    raw = F.coalesce(F.try_url_decode(F.trim(value)), F.trim(value))
    is_url = raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | raw.startswith("//")
    host = F.lower(F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "^(abs|pdf)/", "")
    picked = F.when(is_url, F.when(host.isin(HOSTS), path)).otherwise(raw)
    bare = F.regexp_replace(F.regexp_replace(picked, r"[?#].*$", ""), "^/+|/+$", "")
    return present(F.regexp_replace(bare, r"(?i)\.pdf$", ""))


def paper_identity(value: Column) -> Column:
    """struct(base_id, version_id, version): all null where value is no id."""
    c = id_candidate(value)
    base = present(F.regexp_extract(c, ID, 1))
    version = F.regexp_extract(c, ID, 2).try_cast("int")
    versioned = F.when(version.isNotNull(), F.concat(base, F.lit("v"), version.cast("string"))).otherwise(base)
    return F.struct(base.alias("base_id"), versioned.alias("version_id"), version.alias("version"))


def lookup_aliases(identity: Column) -> Column:
    """The id and its six URL forms, with the version and then without."""
    forms = ["", f"https://{_SITE}/abs/", f"http://{_SITE}/abs/", f"https://{_SITE}/pdf/", f"http://{_SITE}/pdf/"]

    def all_forms(c: Column) -> list[Column]:
        plain = [F.concat(F.lit(f), c) for f in forms]
        return plain + [F.concat(F.lit(f), c, F.lit(".pdf")) for f in forms[3:]]

    return F.array_distinct(F.array(*all_forms(identity["version_id"]), *all_forms(identity["base_id"])))


def canonical_urls(identity: Column) -> Column:
    v = identity["version_id"]
    return F.struct(F.concat(F.lit(f"https://{_SITE}/abs/"), v).alias("abs_url"), F.concat(F.lit(f"https://{_SITE}/pdf/"), v).alias("pdf_url"))


def first_identity(*candidates: Column) -> Column:
    """Identity of the first candidate that has text."""
    return paper_identity(F.coalesce(*[present(c) for c in candidates]))


def version_key(version: Column, *ties: Column) -> Column:
    """Sort key of a version: none sorts as -1, before every number."""
    return F.struct(F.coalesce(version, F.lit(-1)).alias("version"), *ties)


def composite_key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(":", *parts), 256))


def evidence_id(document_hash: Column, chunk_id: Column, page: Column, quote: Column) -> Column:
    normal = F.lower(F.trim(F.regexp_replace(quote, r"\s+", " ")))
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws(":", document_hash, chunk_id, page.cast("string"), normal), 256), 1, 24))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5), from SHA-1 alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def safe_path(c: Column) -> Column:
    """A category as a folder name."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)\.(pdf|html)$", "")
