"""Feather (Arrow IPC) files as a Spark Python data source, one partition per file."""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_REGISTERED: set[int] = set()


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _FeatherReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self):
        return [_FilePartition(f) for f in self.files]

    def read(self, partition):
        import pyarrow.feather as feather
        table = feather.read_table(partition.path)
        yield from table.to_batches()


class FeatherDataSource(DataSource):
    @classmethod
    def name(cls):
        return "feather"

    def _files(self) -> list[str]:
        path = self.options.get("path")
        if os.path.isdir(path):
            return sorted(glob.glob(os.path.join(path, "*.feather")))
        return sorted(glob.glob(path))

    def schema(self):
        import pyarrow.feather as feather
        from pyspark.sql.pandas.types import from_arrow_schema
        files = self._files()
        return from_arrow_schema(feather.read_table(files[0]).schema)

    def reader(self, schema):
        return _FeatherReader(self._files())


def register_feather(spark) -> None:
    key = id(spark)
    if key not in _REGISTERED:
        spark.dataSource.register(FeatherDataSource)
        _REGISTERED.add(key)
