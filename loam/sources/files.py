"""Small files on the store's file system, through Hadoop, so that a store may lie wherever Spark reads and writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make(self, folder: str = "") -> None:
        self._fs.mkdirs(self._path(folder))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, content: bytes) -> None:
        """Fails if the file is there: a claim."""
        stream = self._fs.create(self._path(name), False)
        stream.write(bytearray(content))
        stream.close()

    def replace(self, name: str, content: bytes) -> None:
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(content))
        stream.close()

    def publish(self, name: str, content: bytes, sync: bool = True) -> None:
        """The file appears whole or not at all: written aside, synced, renamed; an existing one is an error."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(aside), True)
        stream.write(bytearray(content))
        if sync:
            stream.hsync()
        stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(aside), self._path(name)):
            self._fs.delete(self._path(aside), False)
            raise FileExistsError(name)

    def move(self, name: str, to: str) -> None:
        self._fs.rename(self._path(name), self._path(to))

    def tree(self, folder: str) -> list[str]:
        """All files below a folder, as the names of their last folder and file."""
        found, out = self._fs.listFiles(self._path(folder), True), []
        while found.hasNext():
            path = found.next().getPath()
            out.append(f"{path.getParent().getName()}/{path.getName()}")
        return out

    def size(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()
