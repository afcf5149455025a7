"""Registered queries over the index engine, and their oracle SQL.

A pruned query takes candidate files from the indexes of a written copy, reads those alone and applies the whole
predicate; its oracle is the plain filter, so a match is a check that pruning loses nothing. Row groups are runs of 100 ids, because ids number the rows of their table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import codecs, kinds
from siftstone.functions.membership import MembershipFilter
from siftstone.operators import dataset, graph, inverted, layers, partitioned, prune, ranking, stats
from siftstone.operators.dataset import Dataset
from siftstone.operators.partitioned import PartitionedIndex
from siftstone.operators.stats import RangePredicate
from siftstone.schemas import ENTITY_KINDS, LAYER, REL_KINDS
from siftstone.session import built, scratch_path, shared_dir, ship
from siftstone.sources import footers, segments

ROWS = 100
EVENT = ["event_id", "ts", "user_id", "event_type", "value"]
_EVENT = ", ".join(EVENT)
HOUR = ("2024-01-10 06:00:00", "2024-01-10 07:00:00")
DAY = ("2024-01-10 00:00:00", "2024-01-11 00:00:00")
WEEK = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared_dir(ship(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def located(spark: SparkSession, sf_dir: str, name: str = "events", key: str = "event_id") -> DataFrame:
    """A table with the virtual row group and offset of each row."""
    return table(spark, sf_dir, name).withColumns({"row_group": F.expr(f"{key} div {ROWS}"), "row_offset": F.expr(f"{key} % {ROWS}")})


def events_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.build_manifest(located(spark, sf_dir), ["ts", "value", "user_id"], ["row_group"])


#: Rows of a file of the indexed copy of events.
FILE_ROWS, MAX_FILES = 1_000, 1_000


def events_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """Events as an indexed dataset, which is built by the first query of a session and opened once."""
    held = built(spark)
    if sf_dir not in held:
        path = scratch_path(spark, "events")
        events = table(spark, sf_dir, "events")
        files = max(8, min(MAX_FILES, events.count() // FILE_ROWS))
        dataset.build(events, path, "ts", ["user_id", "event_type"], options=segments.SegmentOptions(files=files))
        held[sf_dir] = path, Dataset(spark, path)
    return held[sf_dir][1]


def between(bounds: tuple[str, str], column: str = "ts") -> RangePredicate:
    return RangePredicate(column, *map(datetime.fromisoformat, bounds))


def _range(spark: SparkSession, sf_dir: str, bounds: tuple[str, str]) -> DataFrame:
    return events_dataset(spark, sf_dir).read([between(bounds)]).select(*EVENT)


def _range_sql(bounds: tuple[str, str]) -> str:
    return f"SELECT {_EVENT} FROM events WHERE ts BETWEEN TIMESTAMP '{bounds[0]}' AND TIMESTAMP '{bounds[1]}'"


@registered(_range_sql(HOUR))
def range_1h(spark, sf_dir):
    return _range(spark, sf_dir, HOUR)


@registered(_range_sql(DAY))
def range_24h(spark, sf_dir):
    return _range(spark, sf_dir, DAY)


@registered(_range_sql(WEEK))
def range_7d(spark, sf_dir):
    return _range(spark, sf_dir, WEEK)


@registered(f"SELECT {_EVENT} FROM events WHERE ts BETWEEN TIMESTAMP '{WEEK[0]}' AND TIMESTAMP '{WEEK[1]}' AND user_id = 7 AND event_type <> 'error'")
def combined_time_user(spark, sf_dir):
    """A selective key and a range: the files that the key's index and the manifest both name, then the whole predicate."""
    return events_dataset(spark, sf_dir).read([between(WEEK)], {"user_id": 7}).where("event_type <> 'error'").select(*EVENT)


@registered(f"SELECT {_EVENT} FROM events WHERE ts BETWEEN TIMESTAMP '{DAY[0]}' AND TIMESTAMP '{DAY[1]}' AND event_type = 'click'")
def combined_time_category(spark, sf_dir):
    """The flagship: category index and time range intersected, then the rows with the whole predicate."""
    return events_dataset(spark, sf_dir).read([between(DAY)], {"event_type": "click"}).select(*EVENT)


@registered(f"SELECT {_EVENT} FROM events WHERE value > 50")
def uniform_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 50").select(*EVENT)


@registered(f"SELECT {_EVENT} FROM events WHERE user_id = 7")
def point_lookup_hit(spark, sf_dir):
    return events_dataset(spark, sf_dir).read(equal={"user_id": 7}).select(*EVENT)


@registered(f"SELECT {_EVENT} FROM events WHERE user_id = -1")
def point_lookup_miss(spark, sf_dir):
    """An absent key, which the index's filter denies, so that nothing is read."""
    return events_dataset(spark, sf_dir).read(equal={"user_id": -1}).select(*EVENT)


@registered(f"SELECT {_EVENT} FROM events WHERE user_id = 7")
def point_lookup_locations(spark, sf_dir):
    """The rows of a key by their locations: file, row group and offset from the footers of the written copy."""
    copy = segments.read_segment(spark, f"{events_dataset(spark, sf_dir).path}/data")
    located = footers.row_locations(copy, footers.footer_stats(copy))
    index = inverted.build_secondary(located, "user_id", F.col("file_key"), F.col("row_group"), F.col("row_offset"))
    return inverted.fetch(located, inverted.lookup(index, 7)).select(*EVENT)


_MANIFEST = f"SELECT event_id // {ROWS} AS row_group, count(*) AS row_count, min(ts) AS min_ts, max(ts) AS max_ts, count(*) FILTER (WHERE ts IS NULL) AS nulls_ts, min(value) AS min_value, max(value) AS max_value, count(*) FILTER (WHERE value IS NULL) AS nulls_value, min(user_id) AS min_user_id, max(user_id) AS max_user_id, count(*) FILTER (WHERE user_id IS NULL) AS nulls_user_id FROM events GROUP BY 1"


@registered(_MANIFEST)
def stats_manifest(spark, sf_dir):
    return events_manifest(spark, sf_dir)


_DAILY = "SELECT 'data/' || strftime(ts, '%Y-%m-%d') || '.parquet' AS file, (hour(ts) // 8)::BIGINT AS row_group, count(*) AS row_count, min(ts) AS min_ts, max(ts) AS max_ts, count(*) FILTER (WHERE ts IS NULL) AS nulls_ts FROM events GROUP BY 1, 2"


def _daily(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"file": F.concat(F.lit("data/"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".parquet")), "row_group": F.expr("cast(hour(ts) div 8 as bigint)")})
    return stats.build_manifest(e, ["ts"])


@registered(_DAILY)
def stats_manifest_daily(spark, sf_dir):
    return _daily(spark, sf_dir)


def _candidates_sql(where: str) -> str:
    return f"WITH m AS ({_MANIFEST}) SELECT row_group, row_count FROM m WHERE {where}"


def _candidates(spark, sf_dir, *wanted: RangePredicate) -> DataFrame:
    return stats.query_overlap(events_manifest(spark, sf_dir), wanted).select("row_group", "row_count")


@registered(_candidates_sql(f"min_ts <= TIMESTAMP '{DAY[1]}' AND max_ts >= TIMESTAMP '{DAY[0]}' AND min_value <= 0.5 AND max_value >= 0.1"))
def overlap_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, RangePredicate("ts", *map(ntz, DAY)), RangePredicate("value", 0.1, 0.5))


@registered(_candidates_sql("true"))
def overlap_no_predicate(spark, sf_dir):
    return _candidates(spark, sf_dir)


@registered(_candidates_sql("true"))
def overlap_missing_column(spark, sf_dir):
    return _candidates(spark, sf_dir, RangePredicate("no_such_column", "X", "Y"))


@registered(_candidates_sql("min_ts <= TIMESTAMP '2030-01-02' AND max_ts >= TIMESTAMP '2030-01-01'"))
def overlap_disjoint(spark, sf_dir):
    return _candidates(spark, sf_dir, RangePredicate("ts", ntz("2030-01-01"), ntz("2030-01-02")))


@registered(f"WITH m AS ({_MANIFEST}), b AS (SELECT max_ts AS x FROM m WHERE row_group = 3) SELECT row_group, row_count FROM m, b WHERE min_ts <= x AND max_ts >= x")
def overlap_boundary(spark, sf_dir):
    """A range of one instant, which is a row group's upper bound: bounds are inclusive."""
    edge = events_manifest(spark, sf_dir).where("row_group = 3").first().max_ts
    return _candidates(spark, sf_dir, RangePredicate("ts", ntz(str(edge)), ntz(str(edge))))


@registered(_candidates_sql(f"min_ts <= TIMESTAMP '{HOUR[1]}' AND max_ts >= TIMESTAMP '{HOUR[0]}' AND min_ts <= TIMESTAMP '{WEEK[1]}' AND max_ts >= TIMESTAMP '{WEEK[0]}'"))
def same_column_two_ranges(spark, sf_dir):
    return _candidates(spark, sf_dir, RangePredicate("ts", *map(ntz, HOUR)), RangePredicate("ts", *map(ntz, WEEK)))


@registered(f"WITH m AS ({_DAILY}) SELECT count(*) AS row_groups, count(DISTINCT file) AS files FROM m")
def manifest_counts(spark, sf_dir):
    return stats.counts(_daily(spark, sf_dir))


@registered(_DAILY)
def manifest_json_roundtrip(spark, sf_dir):
    """The daily manifest written as JSON and read again."""
    return stats.from_json(stats.to_json(_daily(spark, sf_dir), ["ts"]), {"ts": "timestamp_ntz"})


_INDEX = f"SELECT l_partkey AS key, (l_orderkey // {ROWS}) // 64 AS span, count(*) AS n_locations, list((l_orderkey // {ROWS}) * {ROWS} + l_orderkey % {ROWS} ORDER BY l_orderkey) AS rows FROM lineitem GROUP BY 1, 2"


def _lineitem_index(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return inverted.build_secondary(rows, "l_partkey", F.lit("orders"), F.expr(f"l_orderkey div {ROWS}"), F.expr(f"l_orderkey % {ROWS}"))


@registered(_INDEX)
def secondary_index_lineitem(spark, sf_dir):
    index = _lineitem_index(spark, sf_dir)
    return index.select("key", "span", F.size("locations").cast("long").alias("n_locations"), F.transform("locations", lambda x: x["row_group"] * ROWS + x["row_offset"]).alias("rows"))


@registered("SELECT count(DISTINCT l_partkey) AS keys, count(*) AS locations FROM lineitem")
def secondary_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return inverted.location_counts(inverted.locations_of(rows, "l_partkey", F.lit("orders"), F.expr(f"l_orderkey div {ROWS}"), F.expr(f"l_orderkey % {ROWS}")))


@registered("SELECT count(DISTINCT l_partkey) AS keys, count(*) AS locations FROM lineitem")
def secondary_written(spark, sf_dir):
    """The counts of an index that is written as a segment and read again."""
    path = scratch_path(spark, "index")
    inverted.write_secondary(_lineitem_index(spark, sf_dir), path)
    return inverted.counts(segments.read_segment(spark, path))


def _orders_of(spark, sf_dir, customers: DataFrame) -> DataFrame:
    orders = located(spark, sf_dir, "orders", "o_orderkey").withColumn("file_key", F.lit("orders"))
    index = inverted.build_secondary(orders, "o_custkey", F.col("file_key"), F.col("row_group"), F.col("row_offset"))
    return inverted.fetch(orders, inverted.lookup_many(index, customers.select(F.col("c_custkey").alias("key")))).select("o_orderkey", "o_custkey", "o_totalprice")


@registered("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)")
def secondary_lookup_multi(spark, sf_dir):
    return _orders_of(spark, sf_dir, table(spark, sf_dir, "customer").where("c_custkey % 10 = 3"))


@registered("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def secondary_lookup_all(spark, sf_dir):
    """``secondary_lookup_multi``, whose SQL is fixed, for the keys of all customers."""
    return _orders_of(spark, sf_dir, table(spark, sf_dir, "customer"))


@registered("SELECT k AS key, c_name, c_mktsegment FROM (SELECT unnest(range(-3, 30)) AS k) LEFT JOIN customer ON c_custkey = k")
def multi_key_lookup(spark, sf_dir):
    keys = spark.range(-3, 30).withColumnRenamed("id", "key")
    index = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    return inverted.get_many(index, keys)


@registered("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def prefix_search_part(spark, sf_dir):
    return inverted.prefix_search(table(spark, sf_dir, "part"), "small", "p_name").select("p_partkey", "p_name")


@registered("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.')")
def prefix_search_url(spark, sf_dir):
    return inverted.prefix_search(table(spark, sf_dir, "pages"), "https://blog.", "url").select("page_id", "url")


@registered("SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS position FROM customer")
def ordered_scan(spark, sf_dir):
    return ranking.with_position(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "c_custkey")


@registered("SELECT 0::BIGINT AS generation, count(*) AS key_count, min(c_name) AS min_key, max(c_name) AS max_key, true AS size_is_exact FROM customer")
def segment_meta(spark, sf_dir):
    """A written segment's metadata, whose size is held against the lengths of its files."""
    path = scratch_path(spark, "segment")
    meta = segments.write_segment(table(spark, sf_dir, "customer"), path, "c_name", unique=True)
    files = spark.read.format("binaryFile").load(f"{path}/*.parquet").agg(F.sum("length")).first()[0]
    return meta.select("generation", "key_count", "min_key", "max_key", (F.col("size_bytes") == files).alias("size_is_exact"))


@registered("SELECT k AS key, c_name FROM (SELECT unnest(range(-5, 12)) AS k) JOIN customer ON c_custkey = k")
def segment_filter_get(spark, sf_dir):
    """Single lookups in an opened segment, whose stored filter denies absent keys before anything is read."""
    path = scratch_path(spark, "segment")
    segments.write_segment(table(spark, sf_dir, "customer"), path, "c_custkey", segments.SegmentOptions(stored=True), unique=True)
    opened = segments.Segment(spark, path)
    found = [opened.get(k).select(F.col("c_custkey").alias("key"), "c_name") for k in range(-5, 12)]
    return reduce(DataFrame.union, found)


@registered("SELECT c_name, c_custkey FROM customer WHERE c_name = (SELECT max(c_name) FROM customer) OR c_name = (SELECT min(c_name) FROM customer)")
def segment_get(spark, sf_dir):
    """Keyed reads from a written segment; the equality reaches its Bloom filters and row-group bounds."""
    path = scratch_path(spark, "segment")
    meta = segments.write_segment(table(spark, sf_dir, "customer"), path, "c_name", unique=True).first()
    segment = segments.read_segment(spark, path)
    return inverted.get(segment, meta.min_key, "c_name").union(inverted.get(segment, meta.max_key, "c_name")).select("c_name", "c_custkey")


_LAYERS = """WITH s AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE least(3, 1 + date_diff('day', TIMESTAMP '2024-01-15', date_trunc('day', ts)) // 5) END AS generation FROM events),
layer AS (SELECT user_id AS key, generation::BIGINT AS generation, max(event_id) AS event_id FROM s GROUP BY 1, 2),
layers AS (SELECT l.key, l.generation, e.event_id, e.value, e.event_type = 'error' AS deleted FROM layer l JOIN events e USING (event_id)),
newest AS (SELECT * FROM layers QUALIFY row_number() OVER (PARTITION BY key ORDER BY generation DESC) = 1)
"""


def _layer_rows(spark, sf_dir) -> DataFrame:
    late = F.least(F.lit(3), 1 + F.floor(F.datediff("ts", F.lit("2024-01-15").cast("date")) / 5))
    e = table(spark, sf_dir, "events").withColumn("generation", F.when(F.col("ts") < ntz("2024-01-15"), 0).otherwise(late).cast("long"))
    last = e.groupBy(F.col("user_id").alias("key"), "generation").agg(F.max_by(F.struct("event_id", "value", (F.col("event_type") == "error").alias("deleted")), F.col("event_id")).alias("_r"))
    return last.select("key", "generation", "_r.event_id", "_r.value", "_r.deleted")


@registered(_LAYERS + "SELECT key, generation, event_id, value FROM newest WHERE NOT deleted")
def layered_resolve(spark, sf_dir):
    return layers.resolve(_layer_rows(spark, sf_dir))


@registered(_LAYERS + "SELECT key, generation, event_id, value FROM newest WHERE NOT deleted AND key = 5")
def layered_lookup(spark, sf_dir):
    return layers.lookup(_layer_rows(spark, sf_dir), 5)


@registered(_LAYERS + "SELECT key FROM newest WHERE deleted")
def layered_tombstone(spark, sf_dir):
    rows = _layer_rows(spark, sf_dir)
    return rows.select("key").distinct().join(layers.resolve(rows), "key", "left_anti")


@registered(_LAYERS + "SELECT count(DISTINCT generation) AS segments, count(*) AS total_keys FROM layers")
def layered_total_keys(spark, sf_dir):
    return layers.totals(_layer_rows(spark, sf_dir))


@registered(_LAYERS + "SELECT key, generation, event_id, value FROM newest WHERE NOT deleted")
def merge_base(spark, sf_dir):
    return layers.merge(_layer_rows(spark, sf_dir), scratch_path(spark, "base"))


_LAYER_MANIFEST = _LAYERS + "SELECT generation, CASE WHEN generation = 0 THEN 'base' ELSE 'delta' END AS kind, count(*) AS key_count, (count(*) * 70)::BIGINT AS size_bytes FROM layers GROUP BY 1, 2"


def _layer_manifest(spark, sf_dir) -> DataFrame:
    m = _layer_rows(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("key_count")).withColumns({"kind": F.when(F.col("generation") == 0, "base").otherwise("delta"), "size_bytes": F.col("key_count") * 70})
    return m.withColumn("path", F.concat(F.lit("layers/"), F.col("generation").cast("string"))).select(*LAYER.fieldNames())


@registered(f"WITH m AS ({_LAYER_MANIFEST}) SELECT sum(key_count)::BIGINT AS keys_upper_bound, sum(size_bytes)::BIGINT AS size_bytes, count(*) FILTER (WHERE kind = 'delta') AS deltas FROM m")
def layer_manifest_totals(spark, sf_dir):
    return layers.manifest_totals(_layer_manifest(spark, sf_dir))


@registered(f"WITH m AS ({_LAYER_MANIFEST}) SELECT count(*) FILTER (WHERE kind = 'delta') > 0 AND (count(*) FILTER (WHERE kind = 'delta') >= 10 OR sum(size_bytes) FILTER (WHERE kind = 'delta') / greatest(sum(size_bytes) FILTER (WHERE kind = 'base'), 1) >= 0.30) AS should_merge FROM m")
def should_merge(spark, sf_dir):
    return layers.should_merge(_layer_manifest(spark, sf_dir))


@registered(f"WITH m AS ({_LAYER_MANIFEST}) SELECT 'layers/' || generation AS path, row_number() OVER (ORDER BY generation) - 1 AS place FROM m")
def layer_paths(spark, sf_dir):
    """The base first, then deltas by age; the order is part of the result."""
    paths = [r.path for r in layers.all_paths(_layer_manifest(spark, sf_dir)).collect()]
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, paths))).alias("place", "path")).select("path", F.col("place").cast("long").alias("place"))


@registered(f"WITH m AS ({_LAYER_MANIFEST}) SELECT 'layers/' || generation AS path, generation, kind, key_count, size_bytes FROM m")
def layer_manifest_json(spark, sf_dir):
    """The layer manifest written as JSON and read again."""
    return layers.manifest_from_json(layers.manifest_to_json(_layer_manifest(spark, sf_dir)))


@registered(_LAYERS + "SELECT key, generation, event_id, value FROM newest WHERE NOT deleted")
def layers_opened(spark, sf_dir):
    """Layers written as files, opened by their manifest and resolved."""
    path, rows = scratch_path(spark, "layers"), _layer_rows(spark, sf_dir)
    rows.write.partitionBy("generation").parquet(path)
    m = _layer_manifest(spark, sf_dir).withColumn("path", F.concat(F.lit(f"{path}/generation="), F.col("generation").cast("string")))
    return layers.resolve(layers.open_layers(spark, m)).select("key", "generation", "event_id", "value")


_PARTS = "WITH k AS (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) // 40 AS idx FROM customer), parts AS (SELECT idx, min(c_name) AS min_key, max(c_name) AS max_key, count(*) AS key_count FROM k GROUP BY 1)\n"


def _parts(spark, sf_dir) -> DataFrame:
    return partitioned.manifest(partitioned.split_equal(table(spark, sf_dir, "customer").select("c_name"), "c_name", 40), "c_name")


@registered(_PARTS + "SELECT * FROM parts")
def partition_manifest(spark, sf_dir):
    return _parts(spark, sf_dir)


@registered(_PARTS + ", keys AS (SELECT c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END AS key FROM customer UNION ALL SELECT 'zzzz') SELECT key, (SELECT min(idx) FROM parts WHERE max_key >= key) AS idx FROM keys")
def partition_route(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("x")).alias("key")).union(spark.range(1).select(F.lit("zzzz")))
    return partitioned.route(keys, _parts(spark, sf_dir))


@registered(_PARTS + "SELECT count(*) AS partitions, sum(key_count)::BIGINT AS total_keys, (sum(key_count) // count(*))::BIGINT AS avg_keys FROM parts")
def partition_sizing(spark, sf_dir):
    return partitioned.sizing(_parts(spark, sf_dir))


def _written_parts(spark, sf_dir) -> tuple[str, DataFrame]:
    path = scratch_path(spark, "partitions")
    return path, partitioned.write_partitions(table(spark, sf_dir, "customer"), "c_name", path, 40)


@registered(_PARTS + "SELECT idx, max_key, key_count, true AS named FROM parts")
def partition_json(spark, sf_dir):
    """The manifest of written partitions as JSON and back."""
    path, parts = _written_parts(spark, sf_dir)
    back = partitioned.from_json(partitioned.to_json(parts))
    return back.select("idx", "max_key", "key_count", (F.col("path") == F.concat(F.lit(f"{path}/idx="), F.col("idx").cast("string"))).alias("named"))


@registered(_PARTS + "SELECT count(*) AS partitions, true AS size_is_exact FROM parts")
def partition_total_size(spark, sf_dir):
    """Bytes of all partitions, held against the lengths of their files."""
    path, parts = _written_parts(spark, sf_dir)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0]
    total = partitioned.total_size_bytes(parts).first().size_bytes
    return parts.agg(F.count("*").alias("partitions")).withColumn("size_is_exact", F.lit(total == files))


@registered("SELECT c_name, c_custkey FROM customer WHERE c_custkey < 6")
def partition_get(spark, sf_dir):
    """Single lookups in opened partitions, each in the one that its key is routed to; absent keys give no rows."""
    path, _ = _written_parts(spark, sf_dir)
    index = PartitionedIndex(spark, path, "c_name")
    names = [r.c_name for r in table(spark, sf_dir, "customer").where("c_custkey < 6").collect()]
    found = [index.get(k).select("c_name", "c_custkey") for k in [*names, "", "zzzz", f"{names[0]}x"]]
    return reduce(DataFrame.union, found)


@registered("SELECT c_name, c_custkey FROM customer")
def partition_get_many(spark, sf_dir):
    """Every customer's key, and as many absent ones, routed and looked up at once."""
    path, _ = _written_parts(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))
    return PartitionedIndex(spark, path, "c_name").get_many(names.union(names.select(F.concat("key", F.lit("x"))))).select("c_name", "c_custkey")


_EDGES = """WITH edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'Contains' AS rel_kind FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'Uses' FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'Calls' FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'ships' FROM lineitem)
"""


def _edges(spark, sf_dir) -> DataFrame:
    parts = [("nation", "n", "n_nationkey", "r", "n_regionkey", "Contains"), ("customer", "c", "c_custkey", "n", "c_nationkey", "Uses"), ("orders", "o", "o_orderkey", "c", "o_custkey", "Calls"), ("lineitem", "o", "l_orderkey", "p", "l_partkey", "ships")]
    out = None
    for name, a, src, b, dst, kind in parts:
        e = table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"), F.lit(kind).alias("rel_kind"))
        out = e if out is None else out.union(e)
    return out


@registered(_EDGES + ", ends AS (SELECT src AS entity_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT entity_id, count(*) AS edges, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM ends GROUP BY 1")
def adjacency_build(spark, sf_dir):
    """Degrees; ``adjacency_lists`` has the lists."""
    return graph.degrees(_edges(spark, sf_dir))


_ADJACENCY = """, ends AS (SELECT src AS entity_id, dst AS other, rel_kind, true AS o FROM edges UNION ALL SELECT dst, src, rel_kind, false FROM edges)
SELECT entity_id, coalesce(list(other || ':' || rel_kind ORDER BY other, rel_kind) FILTER (WHERE o), []) AS outgoing, coalesce(list(other || ':' || rel_kind ORDER BY other, rel_kind) FILTER (WHERE NOT o), []) AS incoming FROM ends GROUP BY 1"""


@registered(_EDGES + _ADJACENCY)
def adjacency_lists(spark, sf_dir):
    """The lists themselves; each entity here has one part."""
    named = lambda edges: F.transform(edges, lambda e: F.concat(e["entity_id"], F.lit(":"), e["rel_kind"])).alias(edges)
    return graph.adjacency(_edges(spark, sf_dir)).select("entity_id", named("outgoing"), named("incoming"))


@registered(_EDGES + "SELECT src, dst, rel_kind FROM edges WHERE src IN ('o1', 'o2', 'c3', 'n4')")
def neighbours_1hop(spark, sf_dir):
    seeds = spark.range(1).select(F.explode(F.array(*map(F.lit, ["o1", "o2", "c3", "n4"]))).alias("entity_id"))
    return graph.neighbours(_edges(spark, sf_dir), seeds).select("src", "dst", "rel_kind")


@registered(_EDGES + ", h1 AS (SELECT DISTINCT dst AS e FROM edges WHERE src = 'o7'), h2 AS (SELECT DISTINCT dst AS e FROM edges WHERE src IN (SELECT e FROM h1)) SELECT 'o7' AS entity_id, 0 AS hop UNION ALL SELECT e, 1 FROM h1 UNION ALL SELECT e, 2 FROM h2 WHERE e NOT IN (SELECT e FROM h1)")
def k_hop_2(spark, sf_dir):
    return graph.k_hop(_edges(spark, sf_dir), spark.range(1).select(F.lit("o7").alias("entity_id")), 2)


_FOLDER = r"^[^:]*://[^/?#]*(/[^/?#]*)"


@registered(f"SELECT regexp_extract(url, '{_FOLDER}', 1) AS path, count(*) AS n_entries, list(page_id ORDER BY page_id::VARCHAR) AS pages FROM pages GROUP BY 1")
def path_entries(spark, sf_dir):
    entities = table(spark, sf_dir, "pages").select(F.regexp_extract("url", _FOLDER, 1).alias("path"), F.col("page_id").cast("string").alias("entity_id"), F.lit("File").alias("kind"))
    parts = graph.path_entries(entities).select("path", "part", F.transform("entries", lambda x: x["entity_id"].cast("long")).alias("pages"))
    return graph.whole_lists(parts, "pages").select("path", F.size("pages").cast("long").alias("n_entries"), "pages")


@registered("SELECT name, CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REL_KINDS.items()) + " ELSE 255 END AS code, name AS back FROM (VALUES " + ", ".join(f"('{k}')" for k in [*REL_KINDS, "delegates_to"]) + ") t(name)")
def rel_kind_dictionary(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, [*REL_KINDS, "delegates_to"]))).alias("name"))
    return names.withColumn("code", kinds.rel_kind_code(F.col("name"))).withColumn("back", kinds.rel_kind_name(F.col("code"), F.col("name")))


@registered("SELECT code::INT AS code, CASE code " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in ENTITY_KINDS.items()) + " ELSE 'Other' END AS kind FROM (SELECT unnest(range(0, 256)) AS code)")
def entity_kind_dictionary(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("code"), kinds.entity_kind_name(F.col("id").cast("int")).alias("kind"))


@registered("SELECT k AS key, c_name FROM (SELECT unnest(range(-200, 100)) AS k) JOIN customer ON c_custkey = k")
def bloom_no_false_negative(spark, sf_dir):
    """Keys that a filter over all customers admits, joined exactly with a segment; a filter that denies a customer is refused."""
    path = scratch_path(spark, "segment")
    customers = table(spark, sf_dir, "customer")
    f = MembershipFilter.build(customers, "c_custkey")
    denied = customers.where(~f.admits(spark, F.col("c_custkey"))).count()
    if denied:
        raise ValueError(f"the filter denies {denied} of its keys")
    segments.write_segment(customers, path, "c_custkey", unique=True)
    keys = spark.range(-200, 100).withColumnRenamed("id", "key").where(f.admits(spark, F.col("key")))
    return keys.join(segments.read_segment(spark, path), F.col("key") == F.col("c_custkey")).select("key", "c_name")


@registered()
def bloom_fp_rate(spark, sf_dir):
    """Share of 1000 absent keys that a filter over customers admits, and of all customers (1)."""
    customers = table(spark, sf_dir, "customer")
    f = MembershipFilter.build(customers, "c_custkey")
    rate = lambda df, key: df.agg(F.coalesce(F.avg(f.admits(spark, F.col(key)).cast("double")), F.lit(1.0)).alias("rate"))
    absent, present = rate(spark.range(-1000, 0), "id"), rate(customers, "c_custkey")
    return absent.withColumnRenamed("rate", "false_positive_rate").crossJoin(present.withColumnRenamed("rate", "present_rate"))


@registered(f"SELECT event_id, 'events' AS file_key, event_id // {ROWS} AS row_group, event_id % {ROWS} AS row_offset, 16::BIGINT AS n_bytes FROM events")
def location_codec_roundtrip(spark, sf_dir):
    e = located(spark, sf_dir).select("event_id", codecs.location_to_binary(F.struct(F.lit("events").alias("file_key"), "row_group", "row_offset")).alias("b"))
    return e.select("event_id", F.octet_length("b").cast("long").alias("n_bytes"), codecs.binary_to_location("b").alias("l")).select("event_id", "l.file_key", "l.row_group", "l.row_offset", "n_bytes")


@registered("SELECT count(*) AS row_count, count(DISTINCT o_orderkey) AS key_count, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders")
def footer_manifest(spark, sf_dir):
    """Row counts and bounds from the footers of a written segment."""
    path = scratch_path(spark, "segment")
    segments.write_segment(table(spark, sf_dir, "orders"), path, "o_orderkey", unique=True)
    # keys are counted in the data, rows in the footers
    meta = segments.segment_meta(segments.read_segment(spark, path), "o_orderkey").first()
    f = footers.footer_stats(segments.read_segment(spark, path)).where("column = 'o_orderkey'")
    return f.agg(F.sum("row_count").cast("long").alias("row_count"), F.lit(meta.key_count).alias("key_count"), F.min(F.col("min").cast("long")).alias("min_key"), F.max(F.col("max").cast("long")).alias("max_key"))


@registered(_range_sql(HOUR))
def pruned_files_1h(spark, sf_dir):
    """A range over a sorted copy of events, read from the candidate files only."""
    path = scratch_path(spark, "events")
    segments.write_segment(table(spark, sf_dir, "events"), path, "ts")
    copy = segments.read_segment(spark, path)
    manifest = stats.build_manifest(copy.withColumn("file", F.col("_metadata.file_path")), ["ts"], ["file"])
    return prune.pruned_files(spark, manifest, [RangePredicate("ts", *map(ntz, HOUR))]).select(*EVENT)
