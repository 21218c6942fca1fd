"""A Python data source for paged services: the fetcher is given, so nothing here needs a network."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with options ``fetcher`` (``module:function``), ``pages`` and ``schema``.

    A fetcher takes a page number and gives a list of tuples; an empty page ends a partition. Pages are read in
    partitions of ``pages_per_task``, each in a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["row_schema"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        n, step = int(self.options.get("pages", 1)), int(self.options.get("pages_per_task", 10))
        return [_Pages(i, min(i + step, n + 1)) for i in range(1, n + 1, step)]

    def read(self, partition):
        import importlib

        module, name = self.options["fetcher"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        for page in range(partition.first, partition.last):
            rows = fetch(page)
            if not rows:
                return
            yield from rows
