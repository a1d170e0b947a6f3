"""A paged service as a stream: pages are read by tasks, offsets are durable, and a run ends by the service's own signs.

An offset says for each topic how many of its results have been read. A round is
one micro-batch of the next pages of all open topics, one partition a page; its
rows land in a table of their own before the stop rules are applied to them, so
nothing is asked for twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: (topic, start, size) -> (rows, number of all results of the topic, null if the service does not tell).
Fetch = Callable[[str, int, int], tuple[list[tuple], int | None]]


class _Page(InputPartition):
    def __init__(self, topic: str, start: int, size: int):
        self.topic, self.start, self.size = topic, start, size


def read_page(fetch: Fetch, topic: str, start: int, size: int, attempts: int, delay: float) -> tuple[list[tuple], int | None]:
    """All results from start to below start + size. A failed call is made again after longer and longer waits; a short answer is asked on."""
    rows: list[tuple] = []
    while True:
        for attempt in range(attempts):
            try:
                got, total = fetch(topic, start + len(rows), size - len(rows))
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(delay * 2**attempt)
        rows += got
        if not got or len(rows) >= size or (total is not None and start + len(rows) >= total):
            return rows, total


class _PageReader(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, options: dict, attempts: int, delay: float):
        self.fetch, self.attempts, self.delay = fetch, attempts, delay
        self.until, self.size = json.loads(options["until"]), int(options["size"])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.until

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(t, s, self.size) for t in sorted(end) for s in range(start.get(t, 0), end[t], self.size)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        rows, total = read_page(self.fetch, partition.topic, partition.start, partition.size, self.attempts, self.delay)
        # A page tells of itself even where it has no results.
        yield partition.topic, partition.start, len(rows), total, None
        for row in rows:
            yield partition.topic, partition.start, None, None, row


def page_source(name_: str, schema_: str, fetch: Fetch, attempts: int = 3, delay: float = 1.0) -> type[DataSource]:
    """A streaming source of (topic, start, fetched, total, record); options `until` (the offset to read to) and `size` (results a page)."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return f"topic string, start long, fetched long, total long, record struct<{schema_}>"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _PageReader(fetch, self.options, attempts, delay)

    return Pages


@dataclass
class PagedIngest:
    """Runs over a registered page source. `keep` filters records (such as by date) before a page counts as empty.

    A topic ends at the number of results the service tells (`end`), after
    `max_empty` pages in a row without a kept record (`empty`), or for this run
    after `max_pages` of its pages (`limit`). Pages of a round behind the one
    that ends a topic are not among its results. Under `path`, `landed` holds the
    pages of each batch and `stream` Spark's checkpoint; a run goes on where the
    last one stopped, and a batch that failed is read again into its own folder.
    """

    spark: SparkSession
    source: str
    path: str
    topics: list[str]
    size: int = 100
    ahead: int = 4
    max_pages: int = 1000
    max_empty: int = 3
    keep: str = "true"

    def _landed(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/landed")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.path}/landed/batch=*")

    def pages(self) -> DataFrame:
        """(topic, start, fetched, total, kept) of the pages that were read, those behind an end included."""
        landed = self._landed()
        if landed is None:
            return self.spark.createDataFrame([], "topic string, start long, fetched long, total long, kept long")
        kept = F.count_if(F.col("record").isNotNull() & F.expr(self.keep))
        return landed.groupBy("topic", "start").agg(F.max("fetched").alias("fetched"), F.max("total").alias("total"), kept.alias("kept"))

    def status(self) -> dict[str, dict]:
        """For each topic: pages and results up to its end, where it goes on, and `end`, `empty` or `open`."""
        out = {t: {"pages": 0, "fetched": 0, "kept": 0, "next": 0, "reason": "open", "run": 0} for t in self.topics}
        # One row a page comes to the driver, in order.
        for p in self.pages().where(F.col("topic").isin(self.topics)).orderBy("topic", "start").toLocalIterator():
            s = out[p.topic]
            if s["reason"] != "open":
                continue
            s["pages"] += 1
            s["fetched"] += p.fetched
            s["kept"] += p.kept
            s["next"] = p.start + self.size
            s["run"] = 0 if p.kept else s["run"] + 1
            if (p.total is not None and s["next"] >= p.total) or not p.fetched and p.total is None:
                s["reason"] = "end"
            elif s["run"] >= self.max_empty:
                s["reason"] = "empty"
        return out

    def records(self) -> DataFrame:
        """(topic, record columns) of all pages up to each topic's end, kept ones only."""
        landed = self._landed()
        if landed is None:
            raise FileNotFoundError(f"nothing has been read into {self.path}")
        ends = F.create_map(*[F.lit(x) for t, s in self.status().items() for x in (t, s["next"])])
        return landed.where(F.col("record").isNotNull() & F.expr(self.keep) & (F.col("start") < F.element_at(ends, F.col("topic")))).select("topic", "record.*")

    def run(self) -> dict[str, dict]:
        """Read on until every topic has ended or had max_pages; returns the status, `limit` for the latter."""
        first = {t: s["pages"] for t, s in self.status().items()}
        while True:
            status = self.status()
            for t, s in status.items():
                if s["reason"] == "open" and s["pages"] - first[t] >= self.max_pages:
                    s["reason"] = "limit"
            more = {t: min(self.ahead, self.max_pages - (s["pages"] - first[t])) for t, s in status.items() if s["reason"] == "open"}
            if not more:
                return {t: {k: v for k, v in s.items() if k != "run"} for t, s in status.items()}
            self._round({t: s["next"] + self.size * more.get(t, 0) for t, s in status.items()})

    def _round(self, until: dict[str, int]) -> None:
        def land(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/landed/batch={batch_id}")

        stream = self.spark.readStream.format(self.source).option("until", json.dumps(until)).option("size", self.size).load()
        query = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{self.path}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
