"""Spark session settings shared by the library, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Session settings the report semantics rely on:
# - UTC session zone: date_format/date_trunc on TIMESTAMP_NTZ go through the
#   session zone, so labels must not shift with the machine's zone.
# - ANSI stays on (Spark 4 default); coercions use try_* functions explicitly.
# - AQE re-plans joins from runtime sizes, coalesces small shuffles and splits
#   skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "tally",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` defaults to the ``SPARK_MASTER`` environment value or
    ``local[*]``; on a cluster the launcher normally supplies it.
    """
    master = master or os.environ.get("SPARK_MASTER", "local[*]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def app_key(spark: SparkSession) -> str:
    """Key of the running application, for per-application memo tables."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a SparkContext handle
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The folder comes from the running context or ``spark.checkpoint.dir``.
    Only a local-mode session (tests, bench) may fall back to a fresh
    temporary folder; on a cluster an unset folder is an error, because a
    machine-local path would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        conf = tempfile.mkdtemp(prefix="tally-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    return f"{_scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_base(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-scratch/{app_key(spark)}"


# Fixed value: the setting by which a query that ends removes its shuffle files.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end, not when
    the driver happens to collect its garbage; for writes whose result is read later."""
    before = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders that this application has made. Frames that
    read from them are gone afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
