"""The driver contract: every registered query with SQL against DuckDB, and the import without the optional parts."""

import datetime
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftstone.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    r = duck(sf).execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(repr([plain(dict(zip(names, x, strict=True))[c]) for c in order]) for x in r.fetchall())
    assert sorted(repr([plain(x[c]) for c in order]) for x in rows) == expected


def test_path_entries_of_large_folders(spark, tmp_path):
    rows = spark.range(70_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/en/"), "id").alias("url"))
    odd = spark.createDataFrame([(3, None), (1, None), (7, "none"), (20, "http://h.com/de/1"), (None, "http://h.com/de/1"), (-3, "http://h.com/de/2"), (1, "http://h.com/de/2"), (1, "http://h.com/de/2")], "page_id long, url string")
    rows.union(odd).repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(repr(tuple(r)) for r in catalogue.QUERIES["path_entries"](spark, str(tmp_path)).select("path", "n_entries", "pages").collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert len(got) == 4 and got == sorted(map(repr, c.sql(catalogue.ORACLES["path_entries"]).fetchall()))


def test_membership_rates(spark, sf):
    r = catalogue.QUERIES["bloom_fp_rate"](spark, sf).first()
    assert r.present_rate == 1.0 and r.false_positive_rate < 0.05


def test_entry(spark):
    assert entry.entry(spark).columns == catalogue.EVENT
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_optional_parts(tmp_path):
    for name in ("siftstone", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "siftstone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; from siftstone.plans import catalogue as c; assert set(e.queries()) == set(c.QUERIES); assert set(e.oracle_sql()) == set(c.ORACLES); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert "fine" in done.stdout, done.stderr
