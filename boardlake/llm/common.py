"""Helpers shared by the corpus operators: tables, stored intermediates, text columns."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    The lineage ends at files that every executor can read, and the optimizer knows the
    size of what it reads, so it broadcasts small tables and shuffles large ones.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Estimated size of a stored table, from its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def own_column(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    return base if base not in df.columns else f"{base}_{uuid.uuid4().hex[:8]}"


def partitions_for(rows: int, per_task: int, least: int = 1) -> int:
    return max(least, -(-rows // per_task))


@contextmanager
def short_batches(spark: SparkSession, rows: int = 250):
    """Arrow batches of at most ``rows`` rows for the jobs inside, so that long texts make no large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Broadcast a stored table of ids or other short rows if it has at most ``rows`` rows.

    Beyond that it is left to a shuffled join, which adaptive execution splits where it is skewed.
    """
    return F.broadcast(df) if df.count() <= rows else df
