"""Streaming ingest: each micro-batch of changes becomes a delta layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_deltas(changes: DataFrame, root: str, checkpoint: str, key: str = "key", version: str = "version") -> StreamingQuery:
    """Start writing a stream of (key, ..., deleted, version) as delta layers below ``root``.

    A batch keeps the last change of each key by ``version``. Its layer is named by the batch number, which is also its
    generation, so a batch that is run again after a failure replaces its own layer.
    """

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
        last.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{root}/delta-{number + 1:08d}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
