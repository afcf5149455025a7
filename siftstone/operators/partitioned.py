"""Partitioned indexes: consecutive runs of keys, and which of them a key belongs to."""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from siftstone.operators.ranking import with_position
from siftstone.schemas import DEFAULT_KEYS_PER_PARTITION, PARTITION
from siftstone.session import shared_dir
from siftstone.sources.segments import no_rows, reader
from siftstone.sources.storage import Storage

#: Manifests up to so many partitions are routed by a list in the plan.
MAX_LISTED_PARTITIONS = 10_000
#: Manifests up to so many partitions are held on the driver by ``PartitionedIndex``.
MAX_HELD_PARTITIONS = 1_000_000
MANIFEST = "_partitions.json"


def partition_count(total: int, per_partition: int = DEFAULT_KEYS_PER_PARTITION) -> int:
    if per_partition <= 0:
        raise ValueError("keys per partition must be positive")
    return max(1, -(-total // per_partition))


def split_equal(df: DataFrame, key: str, per_partition: int) -> DataFrame:
    """``df`` with ``idx``: consecutive runs of ``per_partition`` rows by key, the same on every run."""
    return with_position(df, key, name="_position").withColumn("idx", F.floor(F.col("_position") / per_partition).cast("long")).drop("_position")


def manifest(split: DataFrame, key: str) -> DataFrame:
    """(idx, min_key, max_key, key_count) of each partition."""
    return split.groupBy("idx").agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("key_count"))


def write_partitions(df: DataFrame, key: str, path: str, per_partition: int = DEFAULT_KEYS_PER_PARTITION) -> DataFrame:
    """Write ``df`` as equal runs of keys, a folder each, and return the manifest (idx, min_key, max_key, path, key_count,
    size_bytes), which is stored beside them as JSON for ``PartitionedIndex.open``."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split_equal(df, key, per_partition).repartition(n, "idx").sortWithinPartitions("idx", key).write.partitionBy("idx").parquet(path)
    file = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    files = spark.read.parquet(path).select("idx", key, *file).groupBy("idx", "file", "size").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
    bounds = [F.min("lo").alias("min_key"), F.max("hi").alias("max_key")]
    parts = files.groupBy(F.col("idx").cast("long").alias("idx")).agg(*bounds, F.sum("n").alias("key_count"), F.sum("size").alias("size_bytes"))
    parts = parts.select("idx", "min_key", "max_key", F.concat(F.lit(f"{path}/idx="), F.col("idx").cast("string")).alias("path"), "key_count", "size_bytes")
    Storage(spark, path).put(MANIFEST, (to_json(parts).first().json or "").encode())
    return parts


def total_size_bytes(parts: DataFrame) -> DataFrame:
    """One row: ``size_bytes`` of all partitions, 0 without any."""
    return parts.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"))


def to_json(parts: DataFrame) -> DataFrame:
    """One row: ``json`` with the partitions in order; keys are strings."""
    entry = F.struct("idx", F.col("max_key").cast("string").alias("max_key"), "path", "key_count", "size_bytes")
    whole = parts.agg(F.array_sort(F.collect_list(entry)).alias("partitions"))
    return whole.select(F.to_json(F.struct(F.lit(1).alias("version"), "partitions")).alias("json"))


def from_json(table: DataFrame, json: str = "json") -> DataFrame:
    """The manifest (``schemas.PARTITION``) in rows of JSON."""
    schema = StructType([StructField("version", IntegerType()), StructField("partitions", ArrayType(PARTITION))])
    return table.select(F.inline(F.from_json(json, schema, {"mode": "FAILFAST"})["partitions"]))


class PartitionedIndex:
    """Written partitions, opened: the manifest is held on the driver, and a lookup reads one partition.

    A manifest has a row for a million keys; of larger ones than ``MAX_HELD_PARTITIONS`` use ``route``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | None = None):
        self.spark, self.path, self.key = spark, path, key
        text = Storage(spark, path).read_all(MANIFEST).decode()
        self.manifest = from_json(spark.range(1).select(F.lit(text).alias("json")))
        self.entries = self.manifest.orderBy("idx").limit(MAX_HELD_PARTITIONS + 1).collect()
        if len(self.entries) > MAX_HELD_PARTITIONS:
            raise ValueError(f"more than {MAX_HELD_PARTITIONS} partitions; route the keys instead")
        self.max_keys = [e.max_key for e in self.entries]
        self.table = reader(spark, schema).parquet(path)

    def get(self, value: str) -> DataFrame:
        """Rows of a key, from the only partition that may have it; none beyond the last partition."""
        at = find_partition(self.max_keys, value)
        if at is None:
            return no_rows(self.spark, self.table.schema)
        return self.table.where((F.col("idx") == self.entries[at].idx) & (F.col(self.key) == F.lit(value)))

    def get_many(self, keys: DataFrame) -> DataFrame:
        """Rows of all keys in the column ``key`` of ``keys``; each key is looked up in its partition."""
        routed = route(keys.select("key").distinct(), self.manifest).where("idx is not null")
        wanted = routed.select(F.col("idx").alias("wanted_idx"), F.col("key").alias("wanted_key"))
        return self.table.join(wanted, (F.col("idx") == F.col("wanted_idx")) & (F.col(self.key) == F.col("wanted_key")), "left_semi")


def sizing(parts: DataFrame) -> DataFrame:
    """One row: ``partitions``, ``total_keys``, ``avg_keys`` (whole; 0 without partitions)."""
    s = parts.agg(F.count("*").alias("partitions"), F.coalesce(F.sum("key_count"), F.lit(0)).cast("long").alias("total_keys"))
    return s.withColumn("avg_keys", F.when(F.col("partitions") > 0, F.expr("total_keys div partitions")).otherwise(F.lit(0)).cast("long"))


def route(keys: DataFrame, parts: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with ``idx``: the first partition whose largest key isn't below; null beyond the last, and for a null key.

    Partitions are ordered and disjoint, so this is a search in the sorted largest keys. A manifest is small (one row
    for a million keys): after its size is checked it is listed in the plan; a larger one is sorted with the keys.
    """
    bounds = parts.where("max_key is not null").groupBy("max_key").agg(F.min("idx").cast("long").alias("idx"))
    few = bounds.orderBy("max_key").limit(MAX_LISTED_PARTITIONS + 1).collect()
    if len(few) > MAX_LISTED_PARTITIONS:
        return _route_sorted(keys, bounds, key)
    kind = dict(keys.dtypes)[key]
    listed = lambda values, of: F.from_json(F.lit(json.dumps(values)), f"array<{of}>")
    ends, ids = [r.max_key for r in few], [r.idx for r in few]
    # a search in two steps of about the root of the number of partitions
    step = max(1, math.isqrt(len(few)))
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(key)))
    skipped = below(listed(ends[step - 1 :: step], kind)) * step
    at = skipped + below(F.slice(listed(ends, kind), skipped + 1, F.lit(step)))
    return keys.withColumn("idx", F.when(F.col(key).isNotNull(), F.get(listed(ids, "bigint"), at)))


def _route_sorted(keys: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """``route`` for any number of distinct ``bounds`` (max_key, idx): keys and bounds in one descending order.

    Each key takes the last bound before it, and a bound comes before the keys that equal it. Rows are range-partitioned
    once, equal keys spread by row; where a partition has no bound before a key, the nearest one of the partitions
    before it holds. Only one row for each partition passes through a single task.
    """
    shared_dir(keys.sparkSession)
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = [*(c for c in keys.columns if c != "idx"), "idx"]
    asked = keys.drop("idx").withColumns({"_end": F.col(key), "_bound": F.lit(0), "_row": F.monotonically_increasing_id()})
    ends = bounds.select(F.col("max_key").alias("_end"), F.col("idx").alias("_idx"), F.lit(1).alias("_bound"), F.lit(0).cast("long").alias("_row"))
    order = [F.desc("_end"), F.desc("_bound"), F.col("_row")]
    # range bounds come from a sample and may differ between two runs
    ordered = asked.unionByName(ends, allowMissingColumns=True).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lowest = ordered.groupBy("_part").agg(F.min_by("_idx", F.when(F.col("_bound") == 1, F.col("_end"))).alias("_lowest"))
    carried = lowest.withColumn("_carried", F.last("_lowest", ignorenulls=True).over(before)).select("_part", "_carried")
    own = F.last("_idx", ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    routed = ordered.withColumn("_own", own).where("_bound = 0").join(F.broadcast(carried), "_part")
    return routed.withColumn("idx", F.when(F.col("_end").isNotNull(), F.coalesce("_own", "_carried"))).select(*out)


def find_partition(max_keys: Sequence[str], key: str) -> int | None:
    """Position of the first largest key that isn't below ``key``, for a manifest held on the driver."""
    at = bisect.bisect_left(max_keys, key)
    return at if at < len(max_keys) else None
