"""Saved pages of JSON lines as a source that is polled: a cursor says how many pages of which folder were read.

The same cursor serves batches (poll) and streams (the data source `sentrel_pages`, whose offsets are cursors). A cursor of
another folder, or one that no page count can be, is refused rather than read as a start from nothing: that would count
pages twice. Lines that are no JSON objects stay as rows of status unreadable, and a page that cannot be opened is one row
of status lost, so a bad page degrades a batch and never ends it. Pages are ordered by name and don't change; the folder
must be reachable by path from the driver and all executors."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PAGES = "page string, line long, status string, body string"


class BadCursor(ValueError):
    pass


def pages(folder: str) -> list[str]:
    return sorted(n for n in os.listdir(folder) if n.endswith(".jsonl"))


def cursor_of(text: str | None, folder: str, pages_there: int) -> int:
    """Pages read so far, by a cursor; none means from the start."""
    if text is None:
        return 0
    try:
        found = json.loads(text)
        source, seen = found["source"], found["seen"]
    except (ValueError, KeyError, TypeError) as e:
        raise BadCursor("the cursor is corrupt") from e
    if source != os.path.abspath(folder):
        raise BadCursor(f"the cursor belongs to another source: {source}")
    if type(seen) is not int or not 0 <= seen <= pages_there:
        raise BadCursor(f"the cursor is corrupt: {seen!r} of {pages_there} pages")
    return seen


def cursor(folder: str, seen: int) -> str:
    return json.dumps({"source": os.path.abspath(folder), "seen": seen})


def rows_of(folder: str, name: str) -> Iterator[tuple[str, int, str, str | None]]:
    try:
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            for i, line in enumerate(f):
                line = line.rstrip("\n")
                if not line.strip():
                    continue
                try:
                    good = isinstance(json.loads(line), dict)
                except ValueError:
                    good = False
                yield name, i, "ok" if good else "unreadable", line
    except OSError as e:
        yield name, 0, "lost", type(e).__name__


def poll(spark: SparkSession, folder: str, after: str | None, most: int = 1000) -> tuple[DataFrame, str]:
    """The rows of at most `most` further pages, and the cursor behind them; a task for each page."""
    there = pages(folder)
    seen = cursor_of(after, folder, len(there))
    names = there[seen : seen + most]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                columns = list(zip(*rows_of(folder, name))) or [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["page", "line", "status", "body"])

    listed = spark.createDataFrame([(n,) for n in names], "page string").repartition(max(1, len(names)))
    return listed.mapInArrow(run, PAGES), cursor(folder, seen + len(names))


class Page(InputPartition):
    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name


class PageReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.reached = folder, most, None

    def initialOffset(self) -> dict:
        return json.loads(cursor(self.folder, 0))

    def _seen(self, offset: dict) -> int:
        return cursor_of(json.dumps(offset), self.folder, len(pages(self.folder)))

    def latestOffset(self) -> dict:
        # without a limit of pages a batch the end is all that is there; with one, so many more than were handed out
        there = len(pages(self.folder))
        self.reached = there if not self.most else min(there, (self.reached or 0) + self.most)
        return json.loads(cursor(self.folder, self.reached))

    def partitions(self, start: dict, end: dict) -> list[Page]:
        a, b = self._seen(start), self._seen(end)
        self.reached = max(self.reached or 0, b)
        return [Page(self.folder, n) for n in pages(self.folder)[a:b]]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from rows_of(partition.folder, partition.name)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.readStream.format("sentrel_pages").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "sentrel_pages"

    def schema(self) -> str:
        return PAGES

    def streamReader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("most", "0")))
