"""Layers, partitions, graph, streaming."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import graph, layers, partitioned
from siftstone.schemas import LAYER
from siftstone.sources.storage import Storage
from siftstone.streaming.deltas import write_deltas

SCHEMA = "generation long, key string, value string, deleted boolean"


def rows(spark, *layers_):
    return spark.createDataFrame([(g, k, v, v is None) for g, layer in enumerate(layers_) for k, v in layer.items()], SCHEMA)


def resolved(df):
    return {r.key: r.value for r in layers.resolve(df).collect()}


BASE = {"key_a": "base_a", "key_b": "base_b", "key_c": "base_c"}


def test_newest_wins_and_deletions_hide(spark):
    assert resolved(rows(spark, BASE, {"key_b": "new"})) == {**BASE, "key_b": "new"}
    assert resolved(rows(spark, BASE, {"key_b": None})) == {"key_a": "base_a", "key_c": "base_c"}
    many = rows(spark, {"a": "v1", "b": "v1", "c": "v1"}, {"a": "v2"}, {"a": "v3", "d": "v1_new"})
    assert resolved(many) == {"a": "v3", "b": "v1", "c": "v1", "d": "v1_new"}
    assert layers.lookup(many, "a").first().value == "v3" and layers.lookup(many, "z").count() == 0
    assert tuple(layers.totals(many).first()) == (3, 6)
    assert resolved(rows(spark, {"a": "x"}, {"a": None}, {"a": "again"})) == {"a": "again"}


def test_merge(spark, tmp_path):
    df = rows(spark, {"a": "1", "b": "1", "c": "1"}, {"b": None, "d": "2"})
    assert sorted(r.key for r in layers.merge(df, str(tmp_path / "m")).collect()) == ["a", "c", "d"]
    assert layers.merge(rows(spark, {"a": "1"}, {"a": None}), str(tmp_path / "n")).count() == 0


def test_exchange_form(spark):
    base = spark.createDataFrame([(b"a", b"1"), (b"b", b"\xff")], "key binary, value binary")
    assert [bytes(r.key) for r in layers.resolve(layers.from_bytes(base, 0)).collect()] == [b"a"]


def manifest(spark, deltas, size):
    return spark.createDataFrame([("base", 0, "base", 100_000, 7_000_000)] + [(f"d{k}", k + 1, "delta", 50, size) for k in range(deltas)], "path string, generation long, kind string, key_count long, size_bytes long")


@pytest.mark.parametrize(("deltas", "size", "merge"), [(0, 0, False), (1, 5_000, False), (10, 5_000, True), (9, 5_000, False), (1, 2_500_000, True)])
def test_merge_trigger(spark, deltas, size, merge):
    assert layers.should_merge(manifest(spark, deltas, size)).first()[0] is merge


def test_manifest_and_removal(spark, tmp_path):
    m = manifest(spark, 2, 10)
    assert tuple(layers.manifest_totals(m).first()) == (100_100, 7_000_020, 2)
    assert [r.path for r in layers.all_paths(m).collect()] == ["base", "d0", "d1"]
    s = Storage(spark, f"file:{tmp_path}")
    s.put("d0", b"x")
    assert layers.remove_old(s, m) == 3 and not s.exists("d0")


def test_open_layers(spark, tmp_path):
    for k, layer in enumerate((BASE, {"key_b": None})):
        spark.createDataFrame([(a, b, b is None) for a, b in layer.items()], "key string, value string, deleted boolean").write.parquet(str(tmp_path / str(k)))
    m = spark.createDataFrame([(str(tmp_path / str(k)), k, "x", 0, 0) for k in range(2)], "path string, generation long, kind string, key_count long, size_bytes long")
    assert set(resolved(layers.open_layers(spark, m))) == {"key_a", "key_c"}


PARTS = [("ddd", 0), ("mmm", 1), ("zzz", 2)]
ROUTES = {"aaa": 0, "ddd": 0, "eee": 1, "mmm": 1, "nnn": 2, "zzz": 2, "zzzz": None}


def test_routing(spark):
    parts = spark.createDataFrame(PARTS, "max_key string, idx long")
    keys = spark.createDataFrame([(k,) for k in ROUTES], "key string")
    assert {r.key: r.idx for r in partitioned.route(keys, parts).collect()} == ROUTES
    assert {k: partitioned.find_partition([p for p, _ in PARTS], k) for k in ROUTES} == ROUTES
    assert {r.idx for r in partitioned.route(keys, parts.limit(0)).collect()} == {None}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 17])
def test_routing_agrees_with_a_search(spark, n):
    bounds = [f"k{3 * i:03d}" for i in range(n)]
    parts = spark.createDataFrame([(b, i) for i, b in enumerate(bounds)], "max_key string, idx long")
    keys = [f"k{i:03d}" for i in range(3 * n + 3)]
    got = {r.key: r.idx for r in partitioned.route(spark.createDataFrame([(k,) for k in keys], "key string"), parts).collect()}
    assert got == {k: partitioned.find_partition(bounds, k) for k in keys}


@pytest.mark.parametrize("listed", [1, 10_000])
def test_routing_of_any_size(spark, monkeypatch, listed):
    """Gaps, shared boundaries, hot and null keys give the same results whether the manifest is listed or sorted."""
    monkeypatch.setattr(partitioned, "MAX_LISTED_PARTITIONS", listed)
    bounds = sorted([f"k{3 * i:03d}" for i in range(60)] + ["k030", "k030", "k090"])
    parts = spark.createDataFrame([(b, i) for i, b in enumerate(bounds)], "max_key string, idx long").repartition(3)
    keys = ["", *(f"k{i:03d}" for i in range(183)), *(f"k{3 * i:03d}x" for i in range(60)), *["k031"] * 500, "zzzz", None]
    got = partitioned.route(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n long").repartition(5), parts)
    assert got.columns == ["key", "n", "idx"]
    want = [(k, i, None if k is None else partitioned.find_partition(bounds, k)) for i, k in enumerate(keys)]
    assert [tuple(r) for r in got.orderBy("n").collect()] == want
    # a key that ends one partition and begins the next belongs to the first
    ranges = spark.createDataFrame([(0, "a", "c"), (1, "c", "e"), (2, "g", "k")], "idx long, min_key string, max_key string")
    asked = spark.createDataFrame([(k,) for k in ("A", "c", "d", "f", "k", "l")], "key string")
    assert sorted(tuple(r) for r in partitioned.route(asked, ranges).collect()) == [("A", 0), ("c", 0), ("d", 1), ("f", 2), ("k", 2), ("l", None)]


def test_partition_counts():
    assert [partitioned.partition_count(n, 10**6) for n in (0, 10**6, 10**7, 10**9, 1_500_000)] == [1, 1, 10, 1000, 2]
    with pytest.raises(ValueError):
        partitioned.partition_count(1, 0)


def test_equal_split(spark):
    keys = spark.range(1000).select(F.format_string("k%04d", F.col("id")).alias("k"))
    parts = partitioned.manifest(partitioned.split_equal(keys.repartition(7), "k", 300), "k").orderBy("idx").collect()
    assert [(r.idx, r.min_key, r.max_key, r.key_count) for r in parts] == [(0, "k0000", "k0299", 300), (1, "k0300", "k0599", 300), (2, "k0600", "k0899", 300), (3, "k0900", "k0999", 100)]
    empty = partitioned.sizing(spark.createDataFrame([], "idx long, key_count long")).first()
    assert tuple(empty) == (0, 0, 0)


def test_adjacency(spark):
    edges = spark.createDataFrame([("a", "b", "Calls"), ("a", "c", "Imports"), ("b", "c", "delegates_to"), ("a", "b", "Calls")], "src string, dst string, rel_kind string")
    lists = {r.entity_id: r for r in graph.adjacency(edges).collect()}
    assert [tuple(e) for e in lists["a"].outgoing] == [("b", "Calls"), ("b", "Calls"), ("c", "Imports")] and lists["a"].incoming == []
    assert [tuple(e) for e in lists["c"].incoming] == [("a", "Imports"), ("b", "delegates_to")]
    counts = {r.entity_id: (r.edges, r.out_degree, r.in_degree) for r in graph.edge_count(graph.adjacency(edges, part=2)).collect()}
    assert counts == {"a": (3, 3, 0), "b": (3, 1, 2), "c": (2, 0, 2)}
    assert sorted(graph.degrees(edges).collect()) == sorted(graph.edge_count(graph.adjacency(edges)).collect())
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    assert graph.neighbours(edges, seeds).count() == 3
    assert {r.entity_id: r.hop for r in graph.k_hop(edges, seeds, 3).collect()} == {"a": 0, "b": 1, "c": 1}


def test_path_entries(spark):
    df = spark.createDataFrame([("p", "f", "Function"), ("p", "C", "Class"), ("q", "m", "Method")], "path string, entity_id string, kind string")
    got = {r.path: [tuple(e) for e in r.entries] for r in graph.path_entries(df).collect()}
    assert got == {"p": [("C", "Class"), ("f", "Function")], "q": [("m", "Method")]}
    many = spark.range(100).select(F.lit("p").alias("path"), F.col("id").cast("string").alias("entity_id"), F.lit("File").alias("kind"))
    parts = graph.path_entries(many, part=20).collect()
    assert len(parts) > 4 and max(len(r.entries) for r in parts) <= 20 and sorted(int(e.entity_id) for r in parts for e in r.entries) == list(range(100))


def test_streamed_deltas(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, value string, deleted boolean, version long"
    changes = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(source)
    for batch in ([("a", "1", False, 1), ("a", "2", False, 2), ("b", "1", False, 1)], [("b", None, True, 3)]):
        changes(*batch)
        q = write_deltas(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "cp"))
        q.awaitTermination()
    m = spark.createDataFrame([(f"{root}/delta-{k:08d}", k, "delta", 0, 0) for k in (1, 2)], "path string, generation long, kind string, key_count long, size_bytes long")
    assert resolved(layers.open_layers(spark, m)) == {"a": "2"}


def test_null_deleted_is_no_deletion(spark):
    df = spark.createDataFrame([("a", "1", None, 1), ("b", "2", True, 1), ("c", "3", False, 1)], "key string, value string, deleted boolean, generation long")
    assert resolved(df) == {"a": "1", "c": "3"}


def test_layer_manifest_json(spark):
    m = spark.createDataFrame([("l/2", 2, "delta", 5, 50), ("l/0", 0, "base", 100, 7000), ("l/1", 1, "delta", 6, 60)], LAYER)
    assert sorted(layers.manifest_from_json(layers.manifest_to_json(m)).collect()) == sorted(m.collect())
    assert layers.manifest_from_json(layers.manifest_to_json(m.where("kind = 'delta'"))).count() == 2
    assert layers.manifest_from_json(layers.manifest_to_json(m.limit(0))).count() == 0
