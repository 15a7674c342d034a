"""Small files of a folder, through whatever file system Spark reaches it by."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Names are relative to the folder; a path without a scheme is of Spark's default file system."""

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        self._jvm, self._gateway, self._conf = sc._jvm, sc._gateway, sc._jsc.hadoopConfiguration()
        self._hadoop = self._jvm.org.apache.hadoop.fs
        given = self._hadoop.Path(path)
        self.fs = given.getFileSystem(self._conf)
        self.path = self.fs.makeQualified(given).toString()

    def at(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def make(self) -> None:
        self.fs.mkdirs(self.at())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at()))

    def read(self, name: str = "") -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> bool:
        """Whether the file was written: without ``overwrite`` only if there was none, in one step."""
        try:
            stream = self.fs.create(self.at(name), overwrite)
        except Py4JJavaError as e:
            if not overwrite and "AlreadyExists" in str(e.java_exception) or not overwrite and self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, old: str, new: str) -> None:
        """Rename a file over another in one step."""
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self.fs.getUri(), self._conf)
        context.rename(self.at(old), self.at(new), options)

    def move(self, to: str) -> None:
        """Rename the folder to a path that does not exist."""
        if not self.fs.rename(self.at(), self._hadoop.Path(to)):
            raise OSError(f"cannot move {self.path} to {to}")

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.at(name)).getLength() if self.exists(name) else 0
