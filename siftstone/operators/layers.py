"""Layered indexes: a base and newer deltas, of which the newest row of a key counts and deletions hide it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.kinds import is_tombstone
from siftstone.schemas import MAX_DELTA_COUNT, MAX_DELTA_RATIO
from siftstone.sources.storage import Storage


def from_bytes(layer: DataFrame, generation: int) -> DataFrame:
    """A layer of (key, value) in the exchange form, where one byte 0xFF means deleted."""
    return layer.select("key", "value", is_tombstone(F.col("value")).alias("deleted"), F.lit(generation).cast("long").alias("generation"))


def stack(layers: Sequence[DataFrame]) -> DataFrame:
    """All layers' rows (key, ..., deleted, generation)."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def open_layers(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Stacked rows of the layers that a manifest lists; it has one row for each layer."""
    return stack([spark.read.parquet(r.path).withColumn("generation", F.lit(r.generation).cast("long")) for r in manifest.orderBy(F.desc("generation")).collect()])


def resolve(rows: DataFrame, key: str = "key") -> DataFrame:
    """The newest row of each key, unless it is a deletion (null isn't one). Generations must be unique for a key."""
    rest = [c for c in rows.columns if c not in (key, "generation")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("generation")).alias("_row"), F.max("generation").alias("generation"))
    return newest.where(~F.coalesce(F.col("_row.deleted"), F.lit(False))).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest if c != "deleted"], "generation")


def lookup(rows: DataFrame, value, key: str = "key") -> DataFrame:
    """Row of one key; the filter passes below the aggregation."""
    return resolve(rows.where(F.col(key) == F.lit(value)), key)


def merge(rows: DataFrame, path: str, key: str = "key") -> DataFrame:
    """Write the resolved rows as a new base, sorted by key, and read it. A base without rows is valid."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resolve(rows, key).repartitionByRange(n, key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def totals(rows: DataFrame) -> DataFrame:
    """One row: layers, and keys over all layers, repeated and deleted ones included."""
    return rows.agg(F.count_distinct("generation").alias("segments"), F.count("*").alias("total_keys"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: ``keys_upper_bound``, ``size_bytes``, ``deltas`` of a layer manifest (path, generation, kind, key_count, size_bytes)."""
    return manifest.agg(F.sum("key_count").alias("keys_upper_bound"), F.sum("size_bytes").alias("size_bytes"), F.count_if(F.col("kind") == "delta").alias("deltas"))


def should_merge(manifest: DataFrame) -> DataFrame:
    """One row: ``should_merge``, by the number of deltas or their share of the base's bytes."""
    delta = F.col("kind") == "delta"
    size = lambda which: F.coalesce(F.sum(F.when(which, F.col("size_bytes"))), F.lit(0))
    sizes = manifest.agg(F.count_if(delta).alias("n"), size(delta).alias("d"), size(~delta).alias("b"))
    return sizes.select(((F.col("n") > 0) & ((F.col("n") >= MAX_DELTA_COUNT) | (F.col("d") / F.greatest("b", F.lit(1)) >= MAX_DELTA_RATIO))).alias("should_merge"))


def manifest_to_json(manifest: DataFrame) -> DataFrame:
    """One row: ``json`` with the base and the deltas, oldest first; a manifest has one row for each layer, so it is small."""
    ref = F.struct("generation", "path", "key_count", "size_bytes")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, ref)))
    whole = manifest.agg(of("base").alias("base"), of("delta").alias("deltas"))
    return whole.select(F.to_json(F.struct(F.lit(1).alias("version"), F.get("base", 0).alias("base"), "deltas")).alias("json"))


def manifest_from_json(table: DataFrame, json: str = "json") -> DataFrame:
    """The layer manifest in rows of JSON."""
    ref = "struct<generation: bigint, path: string, key_count: bigint, size_bytes: bigint>"
    parsed = table.select(F.from_json(json, f"version int, base {ref}, deltas array<{ref}>", {"mode": "FAILFAST"}).alias("m"))

    def layer(kind: str, rows: Column) -> DataFrame:
        found = parsed.select(F.explode(rows).alias("r")).where("r is not null")
        return found.select("r.path", "r.generation", F.lit(kind).alias("kind"), "r.key_count", "r.size_bytes")

    return layer("base", F.array("m.base")).union(layer("delta", F.col("m.deltas")))


def all_paths(manifest: DataFrame) -> DataFrame:
    """Paths of all layers, the base first and then deltas by age."""
    return manifest.orderBy(F.col("kind") == "delta", "generation").select("path")


def remove_old(storage: Storage, manifest: DataFrame) -> int:
    """Delete the layers of a manifest after a merge, and count them."""
    paths = [r.path for r in all_paths(manifest).collect()]
    for p in paths:
        storage.delete(p)
    return len(paths)
