"""Files on any file system that Spark knows, through its Hadoop client on the driver."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..errors import FileError


class Folder:
    """A folder and what is in it; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._of(name)))

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._of(name)).getLen()

    def identity(self, name: str = "") -> tuple[int, ...]:
        """Length and time of change, ms; of a file of this machine also its change of status, ns, device and number."""
        path = self._of(name)
        status = self._fs.getFileStatus(path)
        known = status.getLen(), status.getModificationTime()
        if self._fs.getUri().getScheme() != "file":
            return known
        own = os.stat(path.toUri().getPath())
        return *known, own.st_ctime_ns, own.st_dev, own.st_ino

    def sha256(self, name: str = "") -> str:
        """Read in a stream by the driver's JVM."""
        stream = self._fs.open(self._of(name))
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def read(self, name: str, most: int) -> str:
        if self.size(name) > most:
            raise FileError(f"{self.path}/{name} is longer than {most} bytes")
        stream = self._fs.open(self._of(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "strict")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file; one that exists is not touched."""
        if self.exists(name):
            raise FileError(f"{self.path}/{name} exists")
        stream = self._fs.create(self._of(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._of(name), True)

    def make(self) -> None:
        self._fs.mkdirs(self._of(""))

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) or not self._fs.rename(self._of(old), self._of(new)):
            raise FileError(f"{self.path}/{new} exists or can't be made")
