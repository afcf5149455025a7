"""Indexed datasets: build once, open, and answer queries from the files that may hold a match.

``build`` writes a copy of a table sorted by its order column, a manifest of every file's bounds, and for each key
column an index of the files that hold a value, with a filter over all values. ``Dataset`` holds manifest and indexes
in memory where their size is bounded, so that a query is planned without a Spark job; larger indexes are looked up as
the segments they are. What the indexes give is a list of files; the whole predicate is applied again to their rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftstone.errors import NotFound
from siftstone.operators import stats
from siftstone.operators.prune import HeldManifest, residual
from siftstone.operators.stats import RangePredicate
from siftstone.sources.segments import Segment, SegmentOptions, no_rows, read_segment, reader, write_segment
from siftstone.sources.storage import Storage

#: Indexes up to so many (value, file) pairs are held on the driver.
MAX_HELD_POSTINGS = 2_000_000
#: Up to so many files are named to the reader, which lists them without a job; more are chosen from the held listing.
FEW_FILES = 32
DATASET = "_dataset.json"


def build(df: DataFrame, path: str, order: str, keys: Sequence[str] = (), bounded: Sequence[str] = (), options: SegmentOptions = SegmentOptions()) -> None:
    """Write the dataset: ``data`` sorted by ``order``, ``manifest`` (bounds of ``order``, ``keys`` and ``bounded``), ``index``."""
    spark = df.sparkSession
    write_segment(df, f"{path}/data", order, options)
    copy = read_segment(spark, f"{path}/data")
    located = copy.withColumn("file", F.col("_metadata.file_path"))
    columns = list(dict.fromkeys([order, *keys, *bounded]))
    stats.build_manifest(located, columns, ["file"]).coalesce(1).write.parquet(f"{path}/manifest")
    for key in keys:
        postings = located.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "file").agg(F.count("*").alias("rows"))
        write_segment(postings, f"{path}/index/{key}", "key", SegmentOptions(stored=True))
    own = {"version": 1, "order": order, "keys": list(keys), "columns": columns, "table": json.loads(df.schema.json()), "schema": json.loads(copy.schema.json())}
    Storage(spark, path).put(DATASET, json.dumps(own).encode())


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


class Postings:
    """An index from a column's values to the files that hold them."""

    def __init__(self, spark: SparkSession, path: str):
        self.segment = Segment(spark, path)
        self.held: dict[Any, np.ndarray] | None = None
        self.files: np.ndarray | None = None
        if self.segment.key_count <= MAX_HELD_POSTINGS:
            table = self.segment.table.select("key", "file").toPandas()
            codes, self.files = table["file"].factorize()
            # one array for all values: a value's files are a slice of it
            self.held = {k: codes[at] for k, at in table.groupby("key", sort=False).indices.items()}

    def find(self, value: Any) -> set[str]:
        """Files that hold a value; the filter denies an absent one without a look at the index."""
        if not self.segment.might_contain(value):
            return set()
        if self.held is not None:
            return set(self.files[self.held[value]]) if value in self.held else set()
        return {r.file for r in self.segment.get(value).select("file").collect()}


class Dataset:
    """An opened dataset."""

    def __init__(self, spark: SparkSession, path: str):
        own = json.loads(Storage(spark, path).read_all(DATASET))
        self.spark, self.path = spark, path
        self.columns = StructType.fromJson(own["table"]).fieldNames()
        self.schema = StructType.fromJson(own["schema"])
        self.manifest = HeldManifest(spark.read.parquet(f"{path}/manifest"), own["columns"], self.schema)
        # the folder is listed once; a query's files are chosen from that listing by the paths that Spark itself gave
        self.table = reader(spark, self.schema).parquet(f"{path}/data")
        self.files = set(self.manifest.files)
        if missing := set(map(_name, self.files)) ^ set(map(_name, self.table.inputFiles())):
            raise NotFound(f"{path}: data and manifest differ in {len(missing)} files, such as {min(missing)}")
        self.postings = {k: Postings(spark, f"{path}/index/{k}") for k in own["keys"]}

    def candidates(self, ranges: Sequence[RangePredicate] = (), equal: Mapping[str, Any] | None = None) -> list[str]:
        """Files that may hold a row within all ranges and with all values; only indexed columns narrow them."""
        files = set(self.manifest.candidates(ranges))
        for column, value in (equal or {}).items():
            if files and column in self.postings:
                files &= self.postings[column].find(value)
        return sorted(files)

    def read(self, ranges: Sequence[RangePredicate] = (), equal: Mapping[str, Any] | None = None) -> DataFrame:
        """Rows within all ranges (Python values, inclusive) and with all values, from the candidate files only."""
        files = self.candidates(ranges, equal)
        if not files:
            return no_rows(self.spark, self.schema).select(*self.columns)
        if len(files) <= FEW_FILES:
            rows = reader(self.spark, self.schema).parquet(*files)
        else:
            rows = self.table if len(files) == len(self.files) else self.table.where(F.col("_metadata.file_path").isin(files))
        rows = residual(rows, self.manifest.typed(ranges))
        for column, value in (equal or {}).items():
            rows = rows.where(F.col(column) == F.lit(value))
        return rows.select(*self.columns)


