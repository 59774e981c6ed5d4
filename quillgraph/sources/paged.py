"""A paged source as a Spark data source: batch and streaming, resumable by offset.

``PagedSource`` reads numbered pages from a ``fetch(start, limit)`` function, the seam for network or export adapters.
Its offset is the number of records read, so a stream resumes from the checkpoint where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class _Page(InputPartition):
    def __init__(self, start: int, limit: int):
        self.start, self.limit = start, limit


def paged_source(name: str, schema_ddl: str, fetch: Callable[[int, int], list[tuple]], page: int = 40) -> type[DataSource]:
    """A DataSource class to register with ``spark.dataSource.register``; ``fetch`` returns fewer rows at the end.

    Options: ``total`` (rows a batch read takes, in pages read in parallel).
    """

    class Reader(DataSourceReader):
        def __init__(self, total: int):
            self.total = total

        def partitions(self) -> list[InputPartition]:
            return [_Page(s, min(page, self.total - s)) for s in range(0, self.total, page)]

        def read(self, part: _Page) -> Iterator[tuple]:
            yield from fetch(part.start, part.limit)

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"read": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows = fetch(start["read"], page)
            return iter(rows), {"read": start["read"] + len(rows)}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(fetch(start["read"], end["read"] - start["read"]))

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema_ddl

        def reader(self, schema) -> DataSourceReader:
            return Reader(int(self.options.get("total", page)))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Stream()

    return Source
