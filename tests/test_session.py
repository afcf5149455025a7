"""Shared folder, scratch tables, and the package on workers that don't have it on their path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from siftstone.session import BATCH_ROWS, built, clear_scratch, scratch_path, scratch_paths, shared_dir, ship

ROOT = Path(__file__).resolve().parent.parent


def test_scratch(spark):
    clear_scratch(spark)
    path = scratch_path(spark, "t")
    assert path.startswith(shared_dir(spark)) and scratch_path(spark, "t") != path
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and clear_scratch(spark) == 2 and not os.path.exists(local) and clear_scratch(spark) == 0


def test_some_scratch_tables_are_removed(spark):
    clear_scratch(spark)
    a, b = scratch_path(spark, "a"), scratch_path(spark, "b")
    for path in (a, b):
        spark.range(3).write.parquet(path)
    built(spark)["x"] = b, None
    assert clear_scratch(spark, {a, "elsewhere"}) == 1 and scratch_paths(spark) == [b] and spark.read.parquet(b).count() == 3
    assert built(spark).pop("x") and clear_scratch(spark) == 1


def test_a_cluster_without_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            isDefined = staticmethod(lambda: False)

                        return Empty

                return Sc

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_batches(spark):
    ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS)


def test_workers_get_the_package_and_a_named_folder_is_used(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from siftstone.session import local_session, ship, shared_dir
spark = ship(local_session(2, **{{"spark.checkpoint.dir": "file://{tmp_path}/shared"}}))
assert shared_dir(spark) == "file://{tmp_path}/shared"
def run(batches):
    import siftstone.functions.codecs
    yield from batches
assert spark.range(5).mapInArrow(run, "id long").count() == 5
assert spark.range(5).checkpoint().count() == 5
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert "fine" in done.stdout, done.stderr[-2000:]
    assert (tmp_path / "shared").is_dir()
