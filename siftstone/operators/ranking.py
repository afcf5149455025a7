"""Positions in a global order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import shared_dir


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` with the 0-based position of each row by ``order``, which should be unique for a definite result.

    Rows are range-partitioned and sorted; a partition's offset is the count of rows before it. The sorted rows are cut
    by a checkpoint, because range bounds come from a sample and may differ between two runs. Only one row for each
    partition passes through a single task.
    """
    shared_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_before")
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
