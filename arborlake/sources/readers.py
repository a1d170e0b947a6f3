"""Sources: feeds, bulk JSON, PDF folders, model metadata, and a paged source of one partition per page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import clean_page, collapse

BULK_SCHEMA = "id string, title string, abstract string, authors string, categories string, versions array<struct<version:string,created:string>>, update_date string, doi string, license string, comments string"


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BULK_SCHEMA).json(path)


def read_suite(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed JSON document; anything that does not fit fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen at random, the same for the same seed: those with the smallest digests of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def names_from(setting: str | None) -> list[str]:
    """Distinct names of a setting, split at commas and white space; at least one."""
    names = list(dict.fromkeys(x for x in re.split(r"[\s,]+", setting or "") if x))
    if not names:
        raise ValueError("at least one name is required")
    return names


def _elements(xml: DataFrame, column: str, tag: str) -> DataFrame:
    """One row per element of that local name, as its own XML text (XPath expressions must be constant)."""
    return xml.select(F.explode(F.regexp_extract_all(column, F.lit(rf"(?s)<(?:\w+:)?{tag}\b.*?</(?:\w+:)?{tag}>"), F.lit(0))).alias("x"))


def _path(path: str) -> str:
    return "".join(f"/*[local-name()='{p}']" for p in path.split("/"))


def parse_feed(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Entries of Atom pages: id, title, summary, published, updated, authors, categories (primary first, distinct)."""
    text = lambda p: F.xpath_string("x", F.lit("/*" + _path(p)))
    many = lambda p, leaf: F.xpath("x", F.lit("/*" + _path(p) + leaf))
    return _elements(xml, column, "entry").select(
        text("id").alias("id"),
        collapse(text("title")).alias("title"),
        collapse(text("summary")).alias("summary"),
        text("published").alias("published"),
        text("updated").alias("updated"),
        F.transform(many("author/name", "/text()"), collapse).alias("authors"),
        F.array_distinct(F.concat(many("primary_category", "/@term"), many("category", "/@term"))).alias("categories"),
    )


def parse_articles(xml: DataFrame, column: str = "xml") -> DataFrame:
    """pmid, title, abstract, journal and authors (last names required) of article pages."""
    get = lambda p: F.xpath_string("x", F.lit(p))
    return _elements(xml, column, "PubmedArticle").select(
        get("//PMID").alias("pmid"), get("//ArticleTitle").alias("title"), get("//AbstractText").alias("abstract"), get("//Journal/Title").alias("journal"), F.xpath("x", F.lit("//Author/LastName/text()")).alias("authors")
    )


def model_metadata(json: DataFrame, column: str = "json") -> DataFrame:
    m = F.from_json(column, "id string, author string, downloads long, likes long, tags array<string>, pipeline_tag string")
    return json.select(m.alias("m")).select("m.id", F.coalesce("m.author", F.lit("unknown")).alias("author"), F.coalesce("m.downloads", F.lit(0)).alias("downloads"), F.coalesce("m.likes", F.lit(0)).alias("likes"), F.coalesce(F.array_contains("m.tags", "chat"), F.lit(False)).alias("is_chat"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, category, stem, sha256, is_pdf) of a folder of PDFs per category."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return b.select("path", F.element_at(parts, -2).alias("category"), F.regexp_replace(F.element_at(parts, -1), r"\.pdf$", "").alias("stem"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text): `extract` turns a file's bytes into page texts, on the executors."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i + 1, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate(extract(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    pages = files.select("path", "content").mapInPandas(run, "path string, page int, text string")
    return pages.withColumn("text", clean_page(F.col("text")))


class _Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int, int], list[tuple]], total: int, size: int):
        self.fetch, self.total, self.size = fetch, total, size

    def partitions(self) -> list[InputPartition]:
        return [_Page(s) for s in range(0, self.total, self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = self.fetch(partition.start, self.size)
        if not rows and partition.start < self.total:
            raise RuntimeError(f"empty page at {partition.start} of {self.total}")
        yield from rows


def paged_source(name_: str, schema_: str, fetch: Callable[[int, int], list[tuple]], count: Callable[[], int], size: int = 100) -> type[DataSource]:
    """A data source over a paged service: one partition a page, so a failed page is a retried task."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return _PagedReader(fetch, count(), size)

    return Paged
