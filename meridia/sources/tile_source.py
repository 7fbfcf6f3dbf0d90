"""Tile sources as Spark data sources: a source names its jobs and fetches one; Spark deals the jobs to tasks.

    class Mine(TileSource):
        def jobs(self): ...
        def fetch(self, col, row): ...

    register(spark, "mine", Mine)
    spark.read.format("mine").option("zoom", 15).load()

A source is built in each task from the options, so it may hold connections. A job whose fetch gives None has a null tile.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "col int, row int, tile binary"


class TileSource(ABC):
    """Jobs (col, row) and the bytes of each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    @abstractmethod
    def jobs(self) -> list[tuple[int, int]]:
        """All jobs, in order."""

    @abstractmethod
    def fetch(self, col: int, row: int) -> bytes | None:
        """A job's tile."""


class _Part(InputPartition):
    def __init__(self, jobs: list[tuple[int, int]]) -> None:
        super().__init__(len(jobs))
        self.jobs = jobs


class _Reader(DataSourceReader):
    def __init__(self, kind: type[TileSource], options: dict[str, str]) -> None:
        self.kind, self.options = kind, options

    def partitions(self) -> list[_Part]:
        jobs, size = self.kind(self.options).jobs(), max(1, int(self.options.get("jobs_per_task", "64")))
        return [_Part(jobs[i : i + size]) for i in range(0, len(jobs), size)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        source = self.kind(self.options)
        for col, row in part.jobs:
            yield col, row, source.fetch(col, row)


def register(spark: SparkSession, name: str, kind: type[TileSource]) -> None:
    """Makes a source known to the session under a name."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(kind, dict(self.options))

    spark.dataSource.register(Source)


class Checkered(TileSource):
    """A source without a server, for trials: cols x rows tiles of `px` bytes; every fifth job has no tile."""

    def jobs(self) -> list[tuple[int, int]]:
        cols, rows = int(self.options.get("cols", "4")), int(self.options.get("rows", "4"))
        return [(c, r) for r in range(rows) for c in range(cols)]

    def fetch(self, col: int, row: int) -> bytes | None:
        return None if (col + row) % 5 == 4 else bytes([(col * 7 + row * 3) % 256]) * int(self.options.get("px", "16"))
