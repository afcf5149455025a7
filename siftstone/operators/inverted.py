"""Inverted indexes and lookups: key to the locations of its rows.

A key's locations are a bag, kept sorted. They are split into lists by row-group range, so that a key which half of all
rows hold is many bounded lists and not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.sources.segments import SegmentOptions, write_segment

#: Row groups whose locations share a list.
SPAN = 64


def build_secondary(rows: DataFrame, key: str, file_key: Column, row_group: Column, row_offset: Column, span: int = SPAN) -> DataFrame:
    """(key, span, locations) with locations sorted; spans number runs of ``span`` row groups."""
    located = locations_of(rows, key, file_key, row_group, row_offset).withColumn("span", F.floor(F.col("location.row_group") / span).cast("long"))
    return located.groupBy("key", "span").agg(F.array_sort(F.collect_list("location")).alias("locations"))


def locations_of(rows: DataFrame, key: str, file_key: Column, row_group: Column, row_offset: Column) -> DataFrame:
    """(key, location) of each row, before lists are made of them."""
    location = F.struct(file_key.cast("string").alias("file_key"), row_group.cast("long").alias("row_group"), row_offset.cast("long").alias("row_offset"))
    return rows.select(F.col(key).alias("key"), location.alias("location"))


def write_secondary(index: DataFrame, path: str, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Write an index as a segment by key, and return its metadata; one without keys is refused (``EmptySegment``)."""
    return write_segment(index, path, "key", options)


def location_counts(located: DataFrame) -> DataFrame:
    """``counts`` without building the lists: keys and locations of (key, location) rows."""
    by_key = located.groupBy("key").agg(F.count("*").alias("n"))
    return by_key.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("locations"))


def counts(index: DataFrame) -> DataFrame:
    """One row: ``keys`` and ``locations``."""
    return index.agg(F.count_distinct("key").alias("keys"), F.coalesce(F.sum(F.size("locations")), F.lit(0)).cast("long").alias("locations"))


def lookup(index: DataFrame, key) -> DataFrame:
    """Locations of one key, as rows; the filter reaches the index's Parquet files."""
    return index.where(F.col("key") == F.lit(key)).select("key", F.inline("locations"))


def lookup_many(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Locations of all keys in the column ``key`` of ``keys``; repeated keys count once."""
    return keys.select("key").distinct().join(index, "key").select("key", F.inline("locations"))


def fetch(base: DataFrame, locations: DataFrame, on: Sequence[str] = ("file_key", "row_group", "row_offset")) -> DataFrame:
    """Rows of ``base`` at the locations; both have the columns ``on``, so that rows of other files don't match."""
    return base.join(locations.select(*on).distinct(), list(on), "left_semi")


def get(index: DataFrame, key, column: str = "key") -> DataFrame:
    return index.where(F.col(column) == F.lit(key))


def get_many(index: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """Every key of ``keys`` with its row, or nulls."""
    return keys.join(index, column, "left")


def prefix_search(index: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    return index.where(F.col(column).startswith(prefix))
