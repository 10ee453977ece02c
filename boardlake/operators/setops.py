"""Ordered output, top-k, best-of selection and set operations (families O and U)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-partitioned sort on unique keys."""
    return df.orderBy(*keys)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``k`` best rows; Spark keeps only k rows per task."""
    return df.orderBy(*order).limit(k)


def select_best(df: DataFrame, keys: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Best row by a lexicographic key; put the tie-breaker last.

    With a filter on rank 1 Spark prunes every group before the exchange.
    """
    part = list(by) or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(*keys)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_all(*dfs: DataFrame) -> DataFrame:
    first, *rest = dfs
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def subset_check(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the key set of ``a`` is a (proper) subset of, or equal to, that of ``b``."""
    seen = (a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionAll(b.select(*keys, F.lit(0), F.lit(1)))
            .groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    only = lambda c: F.count_if(c)
    return (seen.agg(only((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_a"),
                     only((F.col("_b") == 1) & (F.col("_a") == 0)).alias("only_b"))
            .select("only_a", "only_b", (F.col("only_a") == 0).alias("is_subset"),
                    ((F.col("only_a") == 0) & (F.col("only_b") > 0)).alias("is_proper_subset"),
                    ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("is_equal")))
