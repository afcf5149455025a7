"""Pruned reads: candidates from indexes, a scan of those files or row groups only, and the whole predicate again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftstone.errors import is_corruption
from siftstone.operators.stats import RangePredicate, query_overlap
from siftstone.session import scratch_path
from siftstone.sources.segments import MICROS, no_rows, reader

MAX_HELD_ROWS = 1_000_000


def intersect(left: DataFrame, right: DataFrame, on: Sequence[str] = ("file", "row_group")) -> DataFrame:
    """Candidates of both."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def residual(df: DataFrame, predicates: Sequence[RangePredicate]) -> DataFrame:
    """The predicates themselves, with those on a companion column of micros beside timestamps."""
    out = reduce(lambda d, p: d.where(p.matches()), predicates, df)
    for p in predicates:
        if p.column + MICROS in df.columns:
            low, high = (F.unix_micros(F.lit(x).cast("timestamp_ntz").cast("timestamp")) for x in (p.low, p.high))
            out = out.where(F.col(p.column + MICROS).between(low, high))
    return out


def pruned_rows(base: DataFrame, manifest: DataFrame, predicates: Sequence[RangePredicate], by: Sequence[str]) -> DataFrame:
    """Rows of ``base`` that match, read through the row groups that may hold them."""
    candidates = query_overlap(manifest, predicates).select(*by).distinct()
    return residual(base.join(candidates, list(by), "left_semi"), predicates)


def pruned_files(spark: SparkSession, manifest: DataFrame, predicates: Sequence[RangePredicate], schema=None, file: str = "file") -> DataFrame:
    """Rows that match, from only the files that may hold them.

    The list of candidate files comes to the driver, as any file list does, and is handed to the reader explicitly: a
    path that isn't there fails instead of giving no rows. Without candidates the result is empty.
    """
    files = [r[0] for r in query_overlap(manifest, predicates).select(file).distinct().orderBy(file).collect()]
    if not files:
        if schema is None:
            every = manifest.select(file).limit(1).collect()
            if not every:
                raise ValueError("an empty manifest needs a schema")
            schema = spark.read.parquet(every[0][0]).schema
        return no_rows(spark, schema)
    return residual(reader(spark, schema).parquet(*files), predicates)


class HeldManifest:
    """A manifest of bounded size held on the driver, so that a query is pruned without a Spark job.

    Bounds are kept as arrays, one pair for each column; a bound that isn't known keeps its file. Of a larger manifest
    than ``MAX_HELD_ROWS`` use ``pruned_files``, which filters it as a table.
    """

    def __init__(self, manifest: DataFrame, columns: Sequence[str], schema: StructType, file: str = "file"):
        table = manifest.select(file, *[f"{side}_{c}" for c in columns for side in ("min", "max")]).limit(MAX_HELD_ROWS + 1).toPandas()
        if len(table) > MAX_HELD_ROWS:
            raise ValueError(f"more than {MAX_HELD_ROWS} rows; filter the manifest as a table")
        self.spark, self.schema = manifest.sparkSession, schema
        self.files = table[file].to_numpy()
        self.bounds = {c: (table[f"min_{c}"], table[f"max_{c}"]) for c in columns}

    def candidates(self, predicates: Sequence[RangePredicate]) -> list[str]:
        """Files that may hold a match; the predicates' bounds are Python values."""
        keep = np.ones(len(self.files), bool)
        for p in predicates:
            if p.column in self.bounds:
                low, high = self.bounds[p.column]
                unknown = (low.isna() | high.isna()).to_numpy()
                keep &= unknown | ((low <= p.high) & (high >= p.low)).to_numpy()
        return sorted(set(self.files[keep]))

    def typed(self, predicates: Sequence[RangePredicate]) -> list[RangePredicate]:
        """The predicates with bounds of their columns' types."""
        kinds = {f.name: f.dataType for f in self.schema}
        return [RangePredicate(p.column, *(F.lit(x).cast(kinds[p.column]) for x in (p.low, p.high))) for p in predicates]

    def read(self, predicates: Sequence[RangePredicate]) -> DataFrame:
        """Rows that match, from the candidate files only."""
        files = self.candidates(predicates)
        if not files:
            return no_rows(self.spark, self.schema)
        return residual(reader(self.spark, self.schema).parquet(*files), self.typed(predicates))


def with_fallback(spark: SparkSession, indexed: Callable[[], DataFrame], scan: Callable[[], DataFrame]) -> DataFrame:
    """``indexed()``, or ``scan()`` of the base table when the index turns out to be damaged; other errors are raised.

    Damage may lie in any page, so the indexed rows are read once, in all their columns, into a table of the shared
    folder; the result is that table.
    """
    path = scratch_path(spark, "found")
    try:
        df = indexed()
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    except Exception as e:
        if is_corruption(e):
            return scan()
        raise
