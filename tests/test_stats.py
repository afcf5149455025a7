"""Manifests and range pruning."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import prune, stats
from siftstone.operators.stats import RangePredicate

DAY = ["00:00:00Z", "07:59:59Z", "08:00:00Z", "15:59:59Z", "16:00:00Z", "23:59:59Z"]


@pytest.fixture(scope="module")
def series(spark):
    rows = []
    for file, day, category in (("data/2024-01-15.parquet", "2024-01-15", ("A", "Z", 5)), ("data/2024-01-16.parquet", "2024-01-16", (None, None, None))):
        for g in range(3):
            rows.append((file, g, f"{day}T{DAY[2 * g]}", f"{day}T{DAY[2 * g + 1]}", 0, *category))
    return spark.createDataFrame(rows, "file string, row_group long, min_timestamp string, max_timestamp string, nulls_timestamp long, min_category string, max_category string, nulls_category long")


def found(manifest, *predicates):
    return sorted(tuple(r) for r in stats.query_overlap(manifest, predicates).select("file", "row_group").collect())


ONE, TWO = "data/2024-01-15.parquet", "data/2024-01-16.parquet"


@pytest.mark.parametrize(
    ("low", "high", "expected"),
    [
        ("2024-01-15T10:00:00Z", "2024-01-15T14:00:00Z", [(ONE, 1)]),
        ("2024-01-15T06:00:00Z", "2024-01-15T20:00:00Z", [(ONE, 0), (ONE, 1), (ONE, 2)]),
        ("2024-01-15T20:00:00Z", "2024-01-16T04:00:00Z", [(ONE, 2), (TWO, 0)]),
        ("2024-01-20T00:00:00Z", "2024-01-20T23:59:59Z", []),
    ],
)
def test_time_ranges(series, low, high, expected):
    assert found(series, RangePredicate("timestamp", low, high)) == expected


def test_no_predicate_keeps_all(series):
    assert len(found(series)) == 6


def test_unknown_bounds_are_kept(series):
    assert found(series, RangePredicate("category", "a", "b")) == [(TWO, 0), (TWO, 1), (TWO, 2)]
    assert len(found(series, RangePredicate("unknown_col", "X", "Y"))) == 6


def test_every_predicate_must_overlap(spark):
    m = spark.createDataFrame([("f", 0, "00:00", "12:00", "A", "M"), ("f", 1, "12:00", "23:59", "N", "Z")], "file string, row_group long, min_ts string, max_ts string, min_cat string, max_cat string")
    assert found(m, RangePredicate("ts", "10:00", "14:00"), RangePredicate("cat", "A", "F")) == [("f", 0)]


@pytest.mark.parametrize(("low", "high", "n"), [("050", "100", 1), ("200", "300", 1), ("001", "099", 0), ("150", "160", 1), ("201", "300", 0)])
def test_bounds_are_inclusive(spark, low, high, n):
    m = spark.createDataFrame([("f", 0, "100", "200")], "file string, row_group long, min_x string, max_x string")
    assert len(found(m, RangePredicate("x", low, high))) == n


def test_two_ranges_on_one_column_are_tested_apart(spark):
    m = spark.createDataFrame([("f", 0, 0, 100)], "file string, row_group long, min_x long, max_x long")
    assert len(found(m, RangePredicate("x", 1, 2), RangePredicate("x", 50, 60))) == 1


def test_build_counts_nulls_and_keeps_groups_of_nulls(spark):
    df = spark.createDataFrame([("f", 0, 1), ("f", 0, None), ("f", 1, None)], "file string, row_group long, x long")
    m = stats.build_manifest(df, ["x"])
    assert sorted(map(tuple, m.collect())) == [("f", 0, 2, 1, 1, 1), ("f", 1, 1, None, None, 1)]
    assert found(m, RangePredicate("x", 5, 6)) == [("f", 1)]
    assert sorted(r.row_group for r in stats.all_null(m, "x").collect()) == [0, 1]
    assert tuple(stats.counts(m).first()) == (2, 1)


def test_empty_manifest(spark):
    m = stats.build_manifest(spark.createDataFrame([], "file string, row_group long, x long"), ["x"])
    assert found(m, RangePredicate("x", 0, 1)) == [] and tuple(stats.counts(m).first()) == (0, 0)


def test_json_round_trip_and_append(spark):
    df = spark.createDataFrame([("f", 0, 1, "a"), ("f", 1, None, "b"), ("g", 0, 7, None)], "file string, row_group long, x long, s string")
    m = stats.build_manifest(df, ["x", "s"])
    back = stats.from_json(stats.to_json(m, ["x", "s"]), {"x": "bigint", "s": "string"})
    assert sorted(map(str, back.select(*m.columns).collect())) == sorted(map(str, m.collect()))
    more = stats.build_manifest(df.select("file", "row_group", "x"), ["x"])
    assert stats.add_row_groups(m, more).count() == 6


def test_pruning_never_loses_a_row(spark, sf):
    """200 random conjunctions give what a plain scan gives."""
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id", "value", "event_id div 50 AS row_group").cache()
    manifest = stats.build_manifest(events, ["event_id", "user_id", "value"], ["row_group"]).cache()
    rng, rows = random.Random(7), [tuple(r) for r in events.collect()]
    groups = [r.asDict() for r in manifest.collect()]
    names = ["event_id", "user_id", "value"]
    for k in range(200):
        wanted = []
        for c in rng.sample(names, rng.randint(1, 3)):
            a, b = sorted(rng.choice(rows)[names.index(c)] for _ in range(2))
            wanted.append(RangePredicate(c, a, b))
        exact = {r[0] for r in rows if all(p.low <= r[names.index(p.column)] <= p.high for p in wanted)}
        kept = {g["row_group"] for g in groups if all(g[f"min_{p.column}"] <= p.high and g[f"max_{p.column}"] >= p.low for p in wanted)}
        assert {i // 50 for i in exact} <= kept
        if k % 20 == 0:
            assert {r.event_id for r in prune.pruned_rows(events, manifest, wanted, ["row_group"]).collect()} == exact
            assert {r.row_group for r in stats.query_overlap(manifest, wanted).collect()} == kept


def test_range_reaches_the_scan(spark, sf, tmp_path):
    from siftstone.sources import segments

    path = str(tmp_path / "events")
    segments.write_segment(spark.read.parquet(f"{sf}/events.parquet"), path, "ts", segments.SegmentOptions(files=4))
    copy = segments.read_segment(spark, path)
    m = stats.build_manifest(copy.withColumn("file", F.col("_metadata.file_path")), ["ts"], ["file"]).cache()
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-03", "2024-01-04"))
    got = prune.pruned_files(spark, m, [RangePredicate("ts", low, high)])
    assert got.count() == copy.where(F.col("ts").between(low, high)).count() > 0
    assert len(got.inputFiles()) < len(copy.inputFiles()) == 4
    none = prune.pruned_files(spark, m, [RangePredicate("ts", *(F.lit(x).cast("timestamp_ntz") for x in ("2030-01-01", "2030-01-02")))])
    assert none.count() == 0 and none.columns == copy.columns


def test_held_manifest(spark, sf, tmp_path):
    from datetime import datetime

    from siftstone.sources import segments

    path = str(tmp_path / "events")
    segments.write_segment(spark.read.parquet(f"{sf}/events.parquet"), path, "ts", segments.SegmentOptions(files=6))
    copy = segments.read_segment(spark, path)
    m = stats.build_manifest(copy.withColumn("file", F.col("_metadata.file_path")), ["ts", "user_id"], ["file"])
    held = prune.HeldManifest(m, ["ts", "user_id"], copy.schema)
    low, high = datetime(2024, 1, 3), datetime(2024, 1, 4)
    wanted = [RangePredicate("ts", low, high)]
    assert 0 < len(held.candidates(wanted)) < 6 and len(held.candidates([])) == 6
    plain = copy.where("ts between timestamp_ntz'2024-01-03' and timestamp_ntz'2024-01-04'")
    assert sorted(held.read(wanted).collect()) == sorted(plain.collect())
    assert held.read([RangePredicate("user_id", -2, -1)]).count() == 0 and held.candidates([RangePredicate("user_id", -2, -1)]) == []
    assert len(held.candidates([RangePredicate("unknown", 1, 2)])) == 6
    gap = spark.createDataFrame([("a", 1, 2), ("b", None, None)], "file string, min_x long, max_x long")
    assert prune.HeldManifest(gap, ["x"], copy.schema).candidates([RangePredicate("x", 5, 6)]) == ["b"]
