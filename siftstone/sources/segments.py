"""Segments: immutable tables sorted by key, as Parquet with row-group statistics and Bloom filters.

A key column that is a timestamp without zone gets a companion of micros since the epoch, because Parquet row groups
are skipped by it and not by the timestamp.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftstone.errors import DuplicateKey, EmptySegment, InvalidFormat, KeysOutOfOrder
from siftstone.functions.membership import MembershipFilter
from siftstone.sources.storage import Storage

MICROS = "_micros"
META, FILTER = "_segment.json", "_filter.bin"
#: Types of keys that a filter is built over.
FILTERED = ("string", "bigint", "int", "smallint", "tinyint")


@dataclass(frozen=True)
class SegmentOptions:
    """Layout of a segment: bytes of a row group and of a page, files, and whether keys get Bloom filters."""

    row_group_bytes: int = 8 << 20
    page_bytes: int = 64 << 10
    files: int | None = None
    bloom: bool = True
    bloom_fpp: float = 0.0039
    expected_keys_per_row_group: int = 200_000
    #: Store the segment's metadata, and a filter over all its keys, beside the data, for ``Segment.open``.
    stored: bool = False


def check_unique(df: DataFrame, key: str) -> None:
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKey(f"{key} = {twice[0][0]!r} occurs {twice[0][1]} times")


def check_ascending(df: DataFrame, key: str, position: str) -> None:
    """Hold a pre-sorted input to its order: each key must be above the one at the position before.

    Neighbours meet by an equi-join on the position, so no partition holds the whole input.
    """
    here, before = df.select(F.col(position).alias("p"), F.col(key).alias("k")), df.select((F.col(position) + 1).alias("p"), F.col(key).alias("b"))
    bad = here.join(before, "p").where("k <= b").orderBy("p").limit(1).collect()
    if bad:
        raise (DuplicateKey if bad[0].k == bad[0].b else KeysOutOfOrder)(f"{bad[0].k!r} follows {bad[0].b!r}")


def write_segment(df: DataFrame, path: str, key: str, options: SegmentOptions = SegmentOptions(), unique: bool = False) -> DataFrame:
    """Write ``df`` sorted by ``key``, and return its one-row metadata (``segment_meta``).

    Rows are range-partitioned, so that files hold disjoint key ranges, and sorted within files. An empty input is
    refused.
    """
    if df.limit(1).count() == 0:
        raise EmptySegment(path)
    if unique:
        check_unique(df, key)
    kind = dict(df.dtypes)[key]
    if kind == "timestamp_ntz":
        df = df.withColumn(key + MICROS, F.unix_micros(F.col(key).cast("timestamp")))
    files = options.files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("errorifexists").option("parquet.block.size", options.row_group_bytes).option("parquet.page.size", options.page_bytes)
    if options.bloom and not kind.startswith("timestamp"):
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", options.expected_keys_per_row_group).option(f"parquet.bloom.filter.fpp#{key}", options.bloom_fpp)
    out.parquet(path)
    meta = segment_meta(read_segment(df.sparkSession, path), key, path)
    if options.stored:
        _store(df.sparkSession, path, key, kind, meta, options.bloom_fpp)
    return meta


def _store(spark: SparkSession, path: str, key: str, kind: str, meta: DataFrame, fpp: float) -> None:
    """Write ``META`` and, for integers and strings, ``FILTER``; Spark's readers pass over names that begin so."""
    storage, row = Storage(spark, path), meta.first()
    if kind in FILTERED:
        keys = read_segment(spark, path).select(F.col(key).cast("string" if kind == "string" else "long").alias("key"))
        storage.put(FILTER, MembershipFilter.build(keys, "key", fpp, row.key_count).to_bytes(spark))
    own = {"version": 1, "key": key, "kind": kind, "generation": row.generation, "key_count": row.key_count, "size_bytes": row.size_bytes, "min_key": str(row.min_key), "max_key": str(row.max_key)}
    storage.put(META, json.dumps(own).encode())


class Segment:
    """An opened segment: its metadata and filter are read once and held, its table is scanned by lookups."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        storage = Storage(spark, path)
        self.spark, self.path = spark, path
        raw = storage.read_all(META)
        try:
            self.meta = json.loads(raw)
            self.key, self.kind = self.meta["key"], self.meta["kind"]
        except (ValueError, KeyError) as e:
            raise InvalidFormat(f"{path}/{META}") from e
        data = storage.read_all(FILTER) if storage.exists(FILTER) else b""
        self.filter = MembershipFilter.from_bytes(spark, data)
        self.memory_usage = len(raw) + len(data)
        self.table = read_segment(spark, path, schema)

    @property
    def key_count(self) -> int:
        return self.meta["key_count"]

    @property
    def size_bytes(self) -> int:
        return self.meta["size_bytes"]

    def might_contain(self, value) -> bool:
        """Whether the key may be in the segment; no data is read."""
        return self.filter.might_contain(value)

    def get(self, value) -> DataFrame:
        """Rows of a key. One that the filter denies gives a table which the optimizer knows to be empty."""
        if not self.might_contain(value):
            return no_rows(self.spark, self.table.schema)
        return self.table.where(F.col(self.key) == F.lit(value))

    def in_order(self) -> DataFrame:
        return self.table.orderBy(self.key)


def no_rows(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """An empty table that the optimizer knows to be empty, so that nothing is run for it."""
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def read_segment(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The segment's table. A file of no bytes is refused, which a scan would take for one of no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) and any(f.getLen() == 0 for f in fs.listStatus(at) if f.isFile() and f.getPath().getName().startswith("part-")):
        raise InvalidFormat(f"{path} holds a file of no bytes")
    return reader(spark, schema).parquet(path)


def reader(spark: SparkSession, schema: StructType | str | None = None) -> DataFrameReader:
    """A reader that holds pages to their checksums, which Parquet doesn't do by itself."""
    checked = spark.read.option("parquet.page.verify-checksum.enabled", "true")
    return checked.schema(schema) if schema is not None else checked


def segment_meta(df: DataFrame, key: str, path: str = "", generation: int = 0) -> DataFrame:
    """One row: generation, path, size in bytes, number of keys, smallest and largest key (counted, not trusted)."""
    size = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct().agg(F.sum("s")).first()[0] if path else None
    meta = df.agg(F.count("*").alias("key_count"), F.min(key).alias("min_key"), F.max(key).alias("max_key")).withColumn("size_bytes", F.lit(size or 0).cast("long"))
    return meta.select(F.lit(generation).cast("long").alias("generation"), F.lit(path).alias("path"), "size_bytes", "key_count", "min_key", "max_key")
