"""Statistics from Parquet footers: one row per file, row group and column, without reading data.

Footer bounds of long strings may be truncated, so they are bounds and not values. Spark lists the files; executors
open the footers through ``stores``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.sources.stores import open_store, store_settings

SCHEMA = "file string, row_group long, row_count long, first_row long, column string, min string, max string, null_count long"


def footer_stats(table: DataFrame) -> DataFrame:
    """Statistics of the files under ``table`` (rows of ``SCHEMA``); bounds are given as text, null where there are none.

    ``first_row`` is the row index at which a row group begins, which turns a row index into a row group and offset.
    """

    settings = store_settings(table.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                system, name = open_store(file, settings)
                with system.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                first = 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        s = column.statistics
                        has = s is not None and s.has_min_max
                        rows.append((file, g, group.num_rows, first, column.path_in_schema, str(s.min) if has else None, str(s.max) if has else None, s.null_count if s is not None and s.has_null_count else None))
                    first += group.num_rows
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    files = table.sparkSession.createDataFrame([(f,) for f in table.inputFiles()], "file string")
    return files.repartition(max(1, min(len(table.inputFiles()), 1000))).mapInArrow(run, SCHEMA)


def row_locations(table: DataFrame, stats: DataFrame) -> DataFrame:
    """``table`` with (file_key, row_group, row_offset) of each row, by the row groups' first rows."""
    groups = stats.groupBy("file").agg(F.array_sort(F.collect_set(F.struct("first_row", "row_group"))).alias("_groups"))
    located = table.withColumns({"file_key": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}).join(groups.withColumnRenamed("file", "_file"), F.expr("replace(file_key, 'file:///', 'file:/') = replace(_file, 'file:///', 'file:/')"))
    found = F.array_max(F.filter("_groups", lambda g: g["first_row"] <= F.col("_row")))
    return located.withColumn("row_group", found["row_group"]).withColumn("row_offset", F.col("_row") - found["first_row"]).drop("_groups", "_row", "_file")
