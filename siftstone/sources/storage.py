"""Whole objects and byte ranges through Hadoop's file systems, from the driver.

For manifests and small objects. Tables are read and written by Spark itself.
"""

from __future__ import annotations

import base64
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from siftstone.errors import NotFound, StorageFailure


@contextmanager
def _translated(path: str):
    try:
        yield
    except Py4JJavaError as e:
        name = e.java_exception.getClass().getName()
        raise (NotFound if "FileNotFound" in name or "NoSuchFile" in name else StorageFailure)(f"{path}: {e.java_exception.getMessage()}") from e


class Storage:
    """Objects below a root URI (``file:``, ``s3a:``, ``hdfs:`` ...)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def resolve(self, path: str) -> str:
        return str(self._path(path))

    def read_range(self, path: str, start: int, end: int) -> bytes:
        """Bytes [start, end); a range that ends beyond the object fails."""
        if end < start or start < 0:
            raise StorageFailure(f"{path}: no range {start}..{end}")
        with _translated(path):
            stream = self._fs.open(self._path(path))
            try:
                stream.seek(start)
                data = base64.b64decode(self._jvm.java.util.Base64.getEncoder().encodeToString(stream.readNBytes(end - start)))
            finally:
                stream.close()
        if len(data) < end - start:
            raise StorageFailure(f"{path}: {end - start} bytes wanted at {start}, {len(data)} there")
        return data

    def read_tail(self, path: str, n: int) -> bytes:
        size = self.object_size(path)
        if n > size:
            raise StorageFailure(f"{path}: last {n} bytes wanted of {size}")
        return self.read_range(path, size - n, size)

    def object_size(self, path: str) -> int:
        with _translated(path):
            return self._fs.getFileStatus(self._path(path)).getLen()

    def read_all(self, path: str) -> bytes:
        return self.read_range(path, 0, self.object_size(path))

    def put(self, path: str, data: bytes) -> None:
        """Write a whole object, with its folders; one that is there is replaced."""
        with _translated(path):
            stream = self._fs.create(self._path(path), True)
            try:
                stream.write(self._jvm.java.util.Base64.getDecoder().decode(base64.b64encode(data).decode()))
            finally:
                stream.close()

    def delete(self, path: str) -> None:
        """Remove an object or folder; a missing one is no error."""
        with _translated(path):
            self._fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        with _translated(path):
            return self._fs.exists(self._path(path))


def object_store_conf(endpoint: str | None = None, path_style: bool = True) -> dict[str, str]:
    """Session settings for ``s3a:`` roots: the default credentials, or an endpoint of its own with path-style access."""
    conf = {"spark.hadoop.fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider"}
    if endpoint:
        conf |= {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower()}
    return conf
