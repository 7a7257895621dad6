"""Spark session helpers.

Every job runs with the session time zone in UTC (the KPI timestamps are naive UTC) and with
adaptive query execution on.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session
and only sets a local one when nothing is configured (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library needs, whatever the cluster size.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; wide projections (the
    # candidate scoring) would otherwise run interpreted inside one huge generated method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "slicewise",
                  shuffle_partitions: int | None = None, extra: dict | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's required settings.

    ``master`` is only applied when given, so that ``spark-submit`` decides on a cluster.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = driver_memory or "12g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_required_conf(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable required settings to an existing session, and make sure
    Python workers can import this package."""
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session: keep what is there
            pass
    ship_package(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the executors' Python path (``addPyFile`` of a zip), once per
    SparkContext.

    Operators that run Python in tasks (``mapInPandas``, ``transformWithStateInPandas``) pickle
    functions by reference to their module; workers must be able to import ``slicewise``
    whatever the driver's working directory or the cluster's nodes.  The zip is built in the
    checkpoint folder when that is a local path, else on the driver, and Spark distributes it.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    ckpt = checkpoint_dir(spark)
    if "://" in ckpt and not ckpt.startswith("file:"):
        # a cluster file system: build the zip on the driver; addPyFile distributes it to the
        # executors (as --py-files does)
        root = tempfile.mkdtemp(prefix="slicewise-pyfiles-")
    else:
        base = os.path.join(ckpt, f"pyfiles-{uuid.uuid4().hex[:8]}")
        root = base.split(":", 1)[1] if base.startswith("file:") else base
        os.makedirs(root, exist_ok=True)
    stage = os.path.join(root, "src")
    shutil.copytree(pkg, os.path.join(stage, "slicewise"),
                    ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    archive = shutil.make_archive(os.path.join(root, "slicewise"), "zip", stage)
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system path).  Only when the
    session has none (tests, a laptop) do we create a scratch folder and register it.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
        if d:
            return d
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; "
                               f"on {sc.master} a folder of this machine would lose rows")
        d = tempfile.mkdtemp(prefix="slicewise-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh scratch folder and read back, for results that several steps read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
