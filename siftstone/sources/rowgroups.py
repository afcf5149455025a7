"""Reading chosen row groups of Parquet files, where whole files would be too much.

Spark's own scan skips row groups by its pushed filters. This reader is for candidates that come from an index: it
opens only the files and row groups that are named, one task for a handful of them, and the caller re-applies its
predicate. Executors open files through ``stores``, and hold pages to their checksums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftstone.errors import InvalidFormat
from siftstone.sources.stores import open_store, store_settings

#: Rows in a batch that goes back to Spark.
BATCH = 10_000


def read_row_groups(candidates: DataFrame, schema: StructType, partitions: int | None = None) -> DataFrame:
    """Rows of the row groups named in ``candidates`` (file, row_group); repeated names count once.

    Only the columns of ``schema`` are read. A file or row group that isn't there is an error.
    """
    target, settings = to_arrow_schema(schema), store_settings(candidates.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        name, source = None, None
        for batch in batches:
            for file, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    system, path = open_store(file, settings)
                    opened = system.open_input_file(path)
                try:
                    if file != name:
                        name, source = file, pq.ParquetFile(opened, page_checksum_verification=True)
                    table = source.read_row_group(group, columns=target.names)
                except (pa.ArrowInvalid, OSError) as e:
                    raise InvalidFormat(f"{file}, row group {group}: {e}") from e
                for part in table.select(target.names).cast(target).to_batches(max_chunksize=BATCH):
                    yield part

    n = partitions or int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = candidates.select("file", candidates["row_group"].cast("long").alias("row_group")).distinct()
    return named.repartition(n, "file", "row_group").sortWithinPartitions("file", "row_group").mapInArrow(run, schema)
