"""Folders of record files as a data source: read("strandex-records"), for batches and for streams.

Spark's own file sources leave out names that begin with _ as well as those that begin with a dot; only the latter are no records. The
folder is listed by this source, through Arrow's file systems (local, HDFS and object stores), and its files are dealt out by bytes.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT, SCHEMA = "strandex-records", "path string, content binary"
#: Bytes of a partition's files, counting so many for opening each.
BYTES, OPENING = 32 << 20, 1 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the *.md files right in a folder, by path; names that begin with a dot are none."""
    from pyarrow import fs

    at, root = _opened(folder)
    found = at.get_file_info(fs.FileSelector(root, allow_not_found=False))
    rows = [(i.path, i.size, i.mtime_ns or 0) for i in found if i.is_file and i.base_name.endswith(".md") and not i.base_name.startswith(".")]
    return sorted(rows)


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def dealt(files: list[tuple[str, int, int]], most: int = BYTES) -> list[Files]:
    """Partitions of about so many bytes, or of one file."""
    out, total = [], most
    for path, size, _ in files:
        if total + size + OPENING > most:
            out.append(Files([]))
            total = 0
        out[-1].paths.append(path)
        total += size + OPENING
    return out


def contents(folder: str, paths: list[str]) -> Iterator[tuple[str, bytes]]:
    at, _ = _opened(folder)
    for path in paths:
        with at.open_input_stream(path) as f:
            yield path, f.read()


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return Stream(self.options["path"], float(self.options.get("settle", "2")))


class Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        return dealt(listed(self.folder)) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        return contents(self.folder, partition.paths)


class Stream(DataSourceStreamReader):
    """New and changed files, by their time of change. A file counts once it is `settle` seconds old, so none comes before the last offset."""

    def __init__(self, folder: str, settle: float):
        self.folder, self.settle = folder, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in listed(self.folder) if start["until"] < f[2] <= end["until"]])

    def read(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        return contents(self.folder, partition.paths)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's record files."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format(FORMAT).load(folder)


def file_stream(spark: SparkSession, folder: str, settle: float = 2) -> DataFrame:
    """(path, content) of record files as they come or change."""
    spark.dataSource.register(RecordFiles)
    return spark.readStream.format(FORMAT).option("settle", str(settle)).load(folder)
