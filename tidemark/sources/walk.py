"""Directory trees as a table: a Python data source, since the built-in file source has no inode and follows links."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, path string, size bigint, mtime_ns bigint, inode bigint"


class _Part(InputPartition):
    def __init__(self, root: str, folder: str, deep: bool) -> None:
        self.root, self.folder, self.deep = root, folder, deep


def _rows(part: _Part) -> Iterator[tuple]:
    """Regular files of a folder; links are not followed and any error ends the whole scan."""
    todo = [part.folder]
    while todo:
        folder = todo.pop()
        with os.scandir(folder) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                s = e.stat(follow_symlinks=False)
                if stat.S_ISDIR(s.st_mode):
                    if part.deep:
                        todo.append(e.path)
                elif stat.S_ISREG(s.st_mode):
                    yield part.root, e.path, s.st_size, s.st_mtime_ns, s.st_ino or None


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], recursive: bool) -> None:
        self.roots, self.recursive = roots, recursive

    def partitions(self) -> list[_Part]:
        """One for the files of each root, and one for each folder right below it."""
        parts = []
        for root in self.roots:
            parts.append(_Part(root, root, False))
            if self.recursive:
                with os.scandir(root) as entries:
                    parts += [_Part(root, e.path, True) for e in entries if e.is_dir(follow_symlinks=False)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _rows(partition)


class WalkSource(DataSource):
    """``spark.read.format("tidemark_walk").option("roots", "/a\\n/b").option("recursive", "true")``"""

    @classmethod
    def name(cls) -> str:
        return "tidemark_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["roots"].split("\n"), self.options.get("recursive", "true").lower() == "true")


def walk(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    spark.dataSource.register(WalkSource)
    return spark.read.format("tidemark_walk").option("roots", "\n".join(roots)).option("recursive", str(recursive)).load()


def root_identity(root: str) -> tuple[int, int]:
    """(device, inode) of a real directory; anything else is an error, so that a lost root never looks like an empty one."""
    s = os.lstat(root)
    if not stat.S_ISDIR(s.st_mode):
        raise NotADirectoryError(root)
    return s.st_dev, s.st_ino


def guarded(spark: SparkSession, roots: list[str]) -> DataFrame:
    """A scan staged as a whole, given only when every root is the same directory after it as before."""
    from tidemark.session import staged

    before = {r: root_identity(r) for r in roots}
    scan = staged(walk(spark, roots), "scan")
    if before != {r: root_identity(r) for r in roots}:
        raise RuntimeError("a root changed during the scan")
    return scan
