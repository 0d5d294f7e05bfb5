"""A folder on any Hadoop file system: whole small files, one of which only one writer can create."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder that driver and executors share; paths without a scheme lie on the session's default file system.

    ``create`` is the compare-and-set that logs and manifests build on. It is atomic on local disks (a hard link) and wherever a
    rename refuses an existing target, as on HDFS; on an object store it is as good as the connector's conditional create.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self._conf)
        self.path = self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(path)).toString()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self) -> None:
        """Makes the folder, if it isn't there."""
        self._fs.mkdirs(self._at(""))

    def under(self, *names: str) -> str:
        """The path of something in the folder."""
        return "/".join([self.path, *names])

    def names(self, folder: str = "") -> list[str]:
        """Names of the files in a subfolder, sorted; none if there is no such subfolder."""
        at = self._at(folder)
        if not self._fs.exists(at):
            return []
        return sorted(n for s in self._fs.listStatus(at) if not (n := s.getPath().getName()).startswith("."))

    def listing(self, name: str) -> list[tuple[str, int, int]]:
        """(path, size, time) of a file, or of the files in a folder, sorted."""
        return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(self._at(name)))

    def read(self, name: str) -> str | None:
        """A file's text; None if there is no such file."""
        try:
            stream = self._fs.open(self._at(name))
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file, all of it or nothing; False if the name is taken, whoever came first."""
        at = self._at(name)
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at):
            return False
        side = self._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
        out = self._fs.create(side, True)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(side.toUri().getPath(), at.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return bool(self._fs.rename(side, at))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self._fs.delete(side, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
