"""Approximate membership: a Bloom filter over a column, built by an aggregation and tested on the driver or in a scan.

A filter never denies a key that it was built from. No filter at all, or one that can't be read, admits every key.
"""

from __future__ import annotations

import base64

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as JavaColumn

#: False-positive rate of a filter with 8-bit entries.
DEFAULT_FPP = 0.0039


class MembershipFilter:
    """A filter over 64-bit integers or strings; None stands for no filter."""

    def __init__(self, java_filter=None):
        self._filter = java_filter

    @classmethod
    def build(cls, df: DataFrame, column: str, fpp: float = DEFAULT_FPP, expected: int | None = None) -> MembershipFilter:
        """One aggregation; ``expected`` distinct keys are counted approximately when they aren't given."""
        n = expected if expected is not None else df.selectExpr(f"approx_count_distinct(`{column}`) AS n").first().n
        return cls(df._jdf.stat().bloomFilter(column, int(n), float(fpp)) if n else None)

    def might_contain(self, key: int | str | None) -> bool:
        if self._filter is None:
            return True
        if key is None:
            return False
        return bool(self._filter.mightContainLong(key) if isinstance(key, int) else self._filter.mightContainString(key))

    def admits(self, spark: SparkSession, key: Column) -> Column:
        """``might_contain`` for a column of 64-bit integers, tested in a scan; null for a null key."""
        if self._filter is None:
            return F.lit(True)
        of = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
        data = F.lit(self.to_bytes(spark))
        return JavaColumn(of.column(spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(of.expression(data._jc), of.expression(key.cast("long")._jc))))

    def to_bytes(self, spark) -> bytes:
        if self._filter is None:
            return b""
        out = spark._jvm.java.io.ByteArrayOutputStream()
        self._filter.writeTo(out)
        return base64.b64decode(spark._jvm.java.util.Base64.getEncoder().encodeToString(out.toByteArray()))

    @classmethod
    def from_bytes(cls, spark, data: bytes) -> MembershipFilter:
        """Empty or unreadable bytes give a filter that admits everything."""
        if not data:
            return cls(None)
        raw = spark._jvm.java.util.Base64.getDecoder().decode(base64.b64encode(data).decode())
        try:
            return cls(spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(spark._jvm.java.io.ByteArrayInputStream(raw)))
        except (Py4JJavaError, PySparkException):  # a damaged filter must not deny keys
            return cls(None)


def any_might_contain(filters: list[MembershipFilter], key: int | str) -> bool:
    """Whether some layer's filter admits the key; tombstones count as keys."""
    return any(f.might_contain(key) for f in filters)
