"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_TEMPORARY: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "boardlake", **extra: str) -> SparkSession:
    """Build a session; on a cluster leave ``master`` unset so the launcher decides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def base_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Without that setting a local master gets one temporary folder, removed at exit; on a cluster
    executors could not read it, so the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if spark not in _TEMPORARY:
        _TEMPORARY[spark] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _TEMPORARY[spark], ignore_errors=True)
    return _TEMPORARY[spark]


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder for an intermediate table, below :func:`base_folder`."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint below :func:`base_folder`."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint()
