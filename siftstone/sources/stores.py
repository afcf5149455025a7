"""Byte-level access from Python workers to the folders that Spark knows by Hadoop's URIs.

Workers have no JVM, so files that they open themselves (footers, chosen row groups, archives) are reached through
``pyarrow.fs``. Its names of stores and settings differ from Hadoop's; both are translated here, on the driver.
"""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession

from siftstone.errors import StorageFailure

# Hadoop's settings of its S3 store, and what pyarrow calls them.
_S3 = {"fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token", "fs.s3a.endpoint.region": "region"}
_ENDPOINT, _PLAIN = "fs.s3a.endpoint", "fs.s3a.connection.ssl.enabled"


def store_settings(spark: SparkSession) -> dict[str, str]:
    """What workers need of the session's Hadoop settings to open files in an object store."""
    conf = spark._jsc.hadoopConfiguration()
    return {k: conf.get(k) for k in (*_S3, _ENDPOINT, _PLAIN) if conf.get(k)}


def open_store(uri: str, settings: dict[str, str] | None = None) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Hadoop writes it, or of a local path."""
    settings = settings or {}
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri[5:].lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    at = urlsplit(uri)
    if at.scheme in ("s3", "s3a", "s3n"):
        options = {name: settings[k] for k, name in _S3.items() if k in settings}
        if _ENDPOINT in settings:
            options["endpoint_override"] = settings[_ENDPOINT]
            options["scheme"] = "http" if settings.get(_PLAIN) == "false" or settings[_ENDPOINT].startswith("http://") else "https"
        return fs.S3FileSystem(**options), at.netloc + at.path
    if at.scheme in ("abfs", "abfss", "wasb", "wasbs"):
        container, _, host = at.netloc.rpartition("@")
        return fs.AzureFileSystem(host.split(".", 1)[0]), container + at.path
    if at.scheme == "gs":
        return fs.GcsFileSystem(), at.netloc + at.path
    try:
        return fs.FileSystem.from_uri(uri)
    except Exception as e:
        raise StorageFailure(f"{uri}: Python workers can't open files of this store") from e
