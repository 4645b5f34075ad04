"""Boards that answer page by page: a batch data source over windows of pages, and its rows as advertisements.

``spark.dataSource.register(PagedSource)`` and then
``spark.read.format("paged").option("fetch", "package.module:function").load()``.
Planning asks for the last page of each window of six in turn and ends with the window
whose last page is short, so no number of pages is needed; ``pages`` bounds it where one is given.
The function takes a page number, from 0, and gives that page's rows as tuples of
the source's columns; a page after the last one has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx

WINDOW = 6
ROWS = "title string, company string, location string, url string, posted string"


@dataclass
class Pages(InputPartition):
    """A window of consecutive pages, read in one task."""

    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        module, name = options["fetch"].split(":")
        self.fetch = getattr(import_module(module), name)
        self.pages, self.size = int(options.get("pages", 1 << 62)), int(options.get("pagesize", 20))

    def partitions(self) -> list[InputPartition]:
        """The windows up to the one that ends short; a board without rows has one."""
        windows, first = [], 0
        while first < self.pages:
            last = min(first + WINDOW, self.pages)
            windows.append(Pages(first, last))
            if len(self.fetch(last - 1)) < self.size:
                break
            first = last
        return windows

    def read(self, partition: Pages) -> Iterator[tuple]:
        """The window's pages up to the first short one, which is the board's last."""
        for page in range(partition.first, partition.last):
            rows = self.fetch(page)
            yield from rows
            if len(rows) < self.size:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def portal_rows(rows: DataFrame, tag: str) -> DataFrame:
    """A portal's rows as advertisements of the source ``portal-`` and its tag; rows without a title or url are dropped, each key once."""
    known = rows.where(tx.blank_to_null(F.col("title")).isNotNull() & tx.blank_to_null(F.col("url")).isNotNull())
    source = F.lit(f"portal-{tag}")
    key = tx.job_key(source, F.col("title"), F.col("company"), F.col("location"))
    return known.select(key.alias("job_key"), source.alias("source"), F.trim("title").alias("title"), "company", "location", "url", "posted").dropDuplicates(["job_key"])


def release_rows(spark, path: str, columns: dict[str, str]) -> DataFrame:
    """A statistical release in CSV, with a header: the named columns under new names, blank and marked cells (``x``, ``..``, ``F``) as null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    cell = lambda c: F.trim(F.col(f"`{c}`"))
    return raw.select(*[F.when(~cell(c).isin("", "x", "..", "F"), cell(c)).alias(n) for c, n in columns.items()])


def write_datasets(rows: DataFrame, path: str) -> None:
    """One folder per dataset, its skills sorted by their latest demand: columns dataset, skill, month, v."""
    latest = rows.groupBy("dataset", "skill").agg(F.max_by("v", "month").alias("latest"))
    sorted_rows = rows.join(latest, ["dataset", "skill"]).repartition("dataset").sortWithinPartitions("dataset", F.desc("latest"), "skill", "month")
    sorted_rows.drop("latest").write.mode("overwrite").partitionBy("dataset").parquet(path)
