"""Small files on whatever file system Spark reads: local, HDFS or an object store."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """All of the new text or all of the old, whenever the process dies."""
        fresh = self.path(f".{name}.new")
        out = self.fs.create(fresh, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.conf).rename(fresh, self.path(name), how)

    def claim(self, name: str) -> bool:
        """Makes an empty file, if none is there."""
        try:
            self.fs.create(self.path(name), False).close()
        except Exception as e:  # noqa: BLE001
            if self.exists(name) or "AlreadyExists" in str(e):
                return False
            raise
        return True

    def age(self, name: str) -> float:
        """Seconds since a file was written; 0 if it is not there."""
        try:
            return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000
        except Exception:  # noqa: BLE001
            return 0.0

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def listed(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []
