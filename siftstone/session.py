"""Session helpers: a tuned local session and the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Collection

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "siftstone", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the master is local (a test) a temporary folder is made and set as checkpoint
    folder; a cluster without the setting is refused, because its executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftstone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, which ``clear_scratch`` removes."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._siftstone_scratch = [*getattr(sc, "_siftstone_scratch", []), path]
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """What operators have written for themselves so far, oldest first."""
    return list(getattr(spark.sparkContext, "_siftstone_scratch", []))


def clear_scratch(spark: SparkSession, paths: Collection[str] | None = None) -> int:
    """Remove what operators have written for themselves, all of it or some ``paths``, and count it.

    A result reads such tables until it is written itself, so call this afterwards. Checkpoints are removed by Spark,
    when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = spark.sparkContext
    known = scratch_paths(spark)
    gone = known if paths is None else [p for p in known if p in set(paths)]
    sc._siftstone_scratch = [p for p in known if p not in set(gone)]
    for origin, (path, _) in list(built(spark).items()):
        if path in gone:
            del built(spark)[origin]
    for p in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def built(spark: SparkSession) -> dict:
    """(path, opened) of what a session has built in the shared folder, by its origin; ``clear_scratch`` forgets it."""
    sc = spark.sparkContext
    if getattr(sc, "_siftstone_built", None) is None:
        sc._siftstone_built = {}
    return sc._siftstone_built


#: Rows in a batch that goes to a Python worker. Spark's default of 10,000 whole texts is tens of MB, several times over.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session, once for each Spark context.

    Workers then find it whatever folder and path they were started with. Batches to workers are kept at ``BATCH_ROWS``
    unless the session has a size of its own.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if getattr(sc, "_siftstone_shipped", None) is None:
        package = os.path.dirname(os.path.abspath(__file__))
        with tempfile.TemporaryDirectory() as stage:
            shutil.copytree(package, os.path.join(stage, "in", "siftstone"), ignore=shutil.ignore_patterns("__pycache__"))
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "siftstone"), "zip", os.path.join(stage, "in")))
        sc._siftstone_shipped = True
    return spark
