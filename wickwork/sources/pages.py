"""A Spark data source over stored API pages: ``spark.read.format("candle_pages")``.

Each request window is a partition of its own. A page is a JSON file ``<start>-<end>.json`` that holds a list of string
arrays; the transport is a parameter, so that retries can be tried out without a network.
"""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bars import batches


class Refused(Exception):
    """The server won't serve this client: no retry."""


def fetch(get: Callable[[], list], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> list:
    """``get()`` with up to ``tries`` attempts, waiting twice as long after each failure; Refused ends at once."""
    error: Exception | None = None
    for attempt in range(tries):
        try:
            if rows := get():
                return rows
            error = ValueError("an empty page")
        except Refused:
            raise
        except Exception as e:
            error = e
        if attempt + 1 < tries:
            sleep(2**attempt + random.random())
    raise error if error else ValueError("no attempt was made")


class _Window(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tries = options["path"], int(options.get("tries", 5))
        self.windows = batches(int(options["start"]), int(options["end"]), int(options["step"]), int(options.get("size", 200)))

    def partitions(self) -> list[InputPartition]:
        return [_Window(*w) for w in self.windows]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end = partition.value
        file = os.path.join(self.path, f"{start}-{end}.json")
        if not os.path.exists(file):
            return  # a missing page leaves a gap, which the completeness gate judges

        def get() -> list:
            with open(file, encoding="utf-8") as f:
                return json.load(f)

        yield ([[str(x) for x in row] for row in fetch(get, self.tries)],)


class CandlePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candle_pages"

    def schema(self) -> str:
        return "rows array<array<string>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CandlePages)
