"""Statistics manifests: bounds and null counts of columns per file and row group, and which groups may hold a match.

Pruning is advisory: a row group without bounds for a column is kept, and the query re-applies its whole predicate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Times in JSON keep their microseconds.
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class RangePredicate(NamedTuple):
    """``column`` between ``low`` and ``high``, both inclusive."""

    column: str
    low: Any
    high: Any

    def matches(self) -> Column:
        return F.col(self.column).between(self.low, self.high)


def build_manifest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("file", "row_group")) -> DataFrame:
    """One row per ``by`` with ``row_count`` and, for each column c, ``min_c``, ``max_c`` and ``nulls_c``."""
    of = lambda c: [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    stats = [s for c in columns for s in of(c)]
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), *stats)


def add_row_groups(manifest: DataFrame, more: DataFrame) -> DataFrame:
    """Append row groups; columns that one side lacks are unknown there, and repeated groups stay repeated."""
    return manifest.unionByName(more, allowMissingColumns=True)


def overlaps(predicate: RangePredicate, columns: Sequence[str]) -> Column:
    """Whether a row group may hold a row within the predicate."""
    low, high = f"min_{predicate.column}", f"max_{predicate.column}"
    if low not in columns or high not in columns:
        return F.lit(True)
    return F.coalesce((F.col(low) <= predicate.high) & (F.col(high) >= predicate.low), F.lit(True))


def query_overlap(manifest: DataFrame, predicates: Sequence[RangePredicate] = ()) -> DataFrame:
    """Row groups that may hold a match of every predicate; each is tested by itself, and none keeps everything."""
    return reduce(lambda m, p: m.where(overlaps(p, manifest.columns)), predicates, manifest)


def counts(manifest: DataFrame, file: str = "file") -> DataFrame:
    """One row: ``row_groups`` and ``files``."""
    return manifest.agg(F.count("*").alias("row_groups"), F.count_distinct(file).alias("files"))


def all_null(manifest: DataFrame, column: str) -> DataFrame:
    """Row groups that hold nulls of a column, for IS NULL; unknown counts are kept."""
    return manifest.where(F.coalesce(F.col(f"nulls_{column}") > 0, F.lit(True)))


def to_json(manifest: DataFrame, columns: Sequence[str], file: str = "file", row_group: str = "row_group") -> DataFrame:
    """(file, json): each file's row groups with their columns' bounds, typed values as JSON."""
    stats = F.struct(*[F.struct(F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max"), F.col(f"nulls_{c}").alias("null_count")).alias(c) for c in columns])
    group = F.struct(F.col(row_group).alias("row_group"), F.col("row_count"), stats.alias("columns"))
    groups = manifest.groupBy(F.col(file).alias("file")).agg(F.array_sort(F.collect_list(group)).alias("row_groups"))
    return groups.select("file", F.to_json(F.struct(F.lit(1).alias("version"), "file", "row_groups"), _TIMES).alias("json"))


def from_json(table: DataFrame, types: dict[str, str], json: str = "json") -> DataFrame:
    """The manifest in rows of JSON; ``types`` gives each column's type."""
    columns = ", ".join(f"`{c}`: struct<min: {t}, max: {t}, null_count: bigint>" for c, t in types.items())
    schema = f"version int, file string, row_groups array<struct<row_group: bigint, row_count: bigint, columns: struct<{columns}>>>"
    parsed = table.select(F.from_json(json, schema, {"mode": "FAILFAST", **_TIMES}).alias("m"))
    rows = parsed.select(F.col("m.file").alias("file"), F.explode("m.row_groups").alias("g"))
    picked = [F.col(f"g.columns.`{c}`.{a}").alias(f"{b}_{c}") for c in types for a, b in (("min", "min"), ("max", "max"), ("null_count", "nulls"))]
    return rows.select("file", "g.row_group", "g.row_count", *picked)
