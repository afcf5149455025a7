"""Row types of index tables and manifests, and the two dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = T.StructType([T.StructField("file_key", T.StringType()), T.StructField("row_group", T.LongType()), T.StructField("row_offset", T.LongType())])
EDGE = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("rel_kind", T.StringType())])
ADJACENCY = T.StructType([T.StructField("outgoing", T.ArrayType(EDGE)), T.StructField("incoming", T.ArrayType(EDGE))])
PATH_ENTRY = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("kind", T.StringType())])
ENTRY = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType())])
SEGMENT_META = T.StructType([T.StructField("generation", T.LongType()), T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("key_count", T.LongType()), T.StructField("min_key", T.StringType()), T.StructField("max_key", T.StringType())])
LAYER = T.StructType([T.StructField("path", T.StringType()), T.StructField("generation", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("key_count", T.LongType()), T.StructField("size_bytes", T.LongType())])
PARTITION = T.StructType([T.StructField("idx", T.LongType()), T.StructField("max_key", T.StringType()), T.StructField("path", T.StringType()), T.StructField("key_count", T.LongType()), T.StructField("size_bytes", T.LongType())])
ROW_GROUP_REF = T.StructType([T.StructField("file", T.StringType()), T.StructField("row_group", T.LongType())])

# Codes of relation and entity kinds in stored values.
REL_KINDS = {"Calls": 0, "Imports": 1, "Extends": 2, "Implements": 3, "Contains": 4, "Uses": 5, "TypeOf": 6}
CUSTOM_REL_KIND = 255
ENTITY_KINDS = {"Function": 0, "Class": 1, "Method": 2, "Interface": 3, "Module": 4, "File": 5, "Struct": 6, "Enum": 7, "Trait": 8, "Constant": 9, "Variable": 10}
OTHER_ENTITY_KIND = 255
OTHER = "Other"
# Deletion marker and compaction thresholds.
TOMBSTONE = b"\xff"
MAX_DELTA_COUNT = 10
MAX_DELTA_RATIO = 0.30
DEFAULT_KEYS_PER_PARTITION = 1_000_000
