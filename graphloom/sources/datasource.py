"""``spark.read.format("repository").load(tree)``: the sources of a tree as a table.

Register with ``spark.dataSource.register(RepositorySource)``. Every partition reads its share of the files.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources.scan import fnv_many, scan


class _Share(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, share_bytes: int):
        self.path, self.share_bytes = path, share_bytes

    def partitions(self):
        shares, held = [[]], 0
        for f in scan(self.path).files:
            if held and held + f[2] > self.share_bytes:
                shares.append([])
                held = 0
            shares[-1].append(f)
            held += f[2]
        return [_Share(x) for x in shares]

    def read(self, partition):
        for i in range(0, len(partition.files), 64):
            part = partition.files[i : i + 64]
            contents = []
            for path, _, _ in part:
                with open(os.path.join(os.path.realpath(self.path), path), "rb") as f:
                    contents.append(f.read())
            columns = [pa.array([f[0] for f in part]), pa.array([f[1] for f in part]), pa.array([f[2] for f in part], pa.int64()), pa.array(contents, pa.binary()), pa.array(fnv_many(contents))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "language", "size_bytes", "content", "content_fingerprint"])


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, language string, size_bytes long, content binary, content_fingerprint string"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("shareBytes", 64 << 20)))
