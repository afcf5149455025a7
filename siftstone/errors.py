"""Errors of index tables, and whether one means damage or a passing fault."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.errors import PythonException


class SiftError(Exception):
    """Base of the errors below."""


class KeysOutOfOrder(SiftError):
    """Keys of a pre-sorted input don't ascend."""


class DuplicateKey(SiftError):
    """A key occurs twice in a unique index."""


class EmptySegment(SiftError):
    """An index without entries was asked for."""


class StorageFailure(SiftError):
    """Reading or writing a file failed for a reason outside the file; worth another try."""


class NotFound(StorageFailure):
    """The file isn't there."""


class ValueDecodeError(SiftError):
    """A binary value can't be decoded."""


class TooShort(ValueDecodeError):
    pass


class InvalidUtf8(ValueDecodeError):
    pass


class InvalidFormat(ValueDecodeError):
    pass


# Error conditions of Spark, and classes of Java, Parquet and codecs, that an error's chain of causes shows.
_DAMAGE_CONDITIONS = ("FAILED_READ_FILE.CANNOT_READ_FILE_FOOTER",)
_MISSING_CONDITIONS = ("PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST", "TABLE_OR_VIEW_NOT_FOUND")
_DAMAGE_CLASSES = ("org.apache.parquet.", "org.xerial.snappy.", "com.github.luben.zstd.", "io.airlift.compress.", "java.util.zip.", "java.io.EOFException")
_MISSING_CLASSES = ("java.io.FileNotFoundException", "java.nio.file.NoSuchFileException")
_PASSING_CLASSES = (
    "java.net.", "javax.net.", "java.util.concurrent.TimeoutException", "java.nio.channels.", "org.apache.http.conn.", "org.apache.spark.shuffle.FetchFailedException",
    "org.apache.hadoop.fs.s3a.AWSServiceThrottledException", "org.apache.hadoop.fs.s3a.AWSStatus500Exception", "org.apache.hadoop.fs.s3a.AWSServiceIOException", "org.apache.hadoop.ipc.RetriableException",
)
#: What Parquet says, in a bare ``RuntimeException``, of a file without its magic number.
_NOT_PARQUET = "is not a Parquet file"
#: Spark's exceptions begin with their condition.
_CONDITION = re.compile(r"\[([A-Z_]+(?:\.[A-Z_]+)*)\]")
#: The last line of a traceback that a Python worker sends names the class that was raised.
_RAISED = re.compile(r"^((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)(?::|$)")


class _Cause(NamedTuple):
    kind: str
    condition: str
    message: str


def _causes(error: BaseException) -> list[_Cause]:
    """The chain of causes: Java's classes and Spark's error conditions, or the Python class."""
    at = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    condition = getattr(error, "getCondition", lambda: None)() or ""
    found = [_Cause(f"{type(error).__module__}.{type(error).__qualname__}", condition, "")]
    if isinstance(error, PythonException):
        lines = [m.group(1) for line in str(error).splitlines() if (m := _RAISED.match(line.strip()))]
        found += [_Cause(lines[-1], "", "")] if lines else []
    while at is not None and len(found) < 30:
        kind, message = at.getClass().getName(), at.getMessage() or ""
        named = _CONDITION.match(message) if kind.startswith("org.apache.spark.") else None
        found.append(_Cause(kind, named.group(1) if named else "", message))
        at = at.getCause()
    return found


def _any(error: BaseException, classes: tuple[str, ...], conditions: tuple[str, ...] = ()) -> bool:
    return any(c.kind.startswith(classes) or (conditions and c.condition.startswith(conditions)) for c in _causes(error))


def is_not_found(error: BaseException) -> bool:
    return isinstance(error, NotFound | FileNotFoundError) or _any(error, (*_MISSING_CLASSES, "FileNotFoundError", "siftstone.errors.NotFound"), _MISSING_CONDITIONS)


def is_corruption(error: BaseException) -> bool:
    """Whether the index is damaged: it should be ignored and the base table scanned."""
    if isinstance(error, StorageFailure):
        return False
    if isinstance(error, ValueDecodeError):
        return True
    if is_not_found(error) or _any(error, _PASSING_CLASSES):
        return False
    own = tuple(f"siftstone.errors.{c.__name__}" for c in (ValueDecodeError, TooShort, InvalidUtf8, InvalidFormat))
    return _any(error, (*_DAMAGE_CLASSES, *own), _DAMAGE_CONDITIONS) or any(c.kind == "java.lang.RuntimeException" and _NOT_PARQUET in c.message for c in _causes(error))


def is_transient(error: BaseException) -> bool:
    """Whether another try may help; damage and missing files are not of that kind."""
    if isinstance(error, StorageFailure):
        return not isinstance(error, NotFound)
    if isinstance(error, ConnectionError | TimeoutError):
        return True
    return not is_not_found(error) and _any(error, (*_PASSING_CLASSES, "siftstone.errors.StorageFailure"))
