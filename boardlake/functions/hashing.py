"""Stable keyed hashes: the only source of randomness in sampling operators."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined with ``|``; strings name columns."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def hash_number(digest: Column, digits: int = 15) -> Column:
    """Leading hex digits as a bigint (15 digits stay inside 63 bits)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash_unit(digest: Column) -> Column:
    """Leading 12 hex digits as a double in [0, 1)."""
    return hash_number(digest, 12) / F.lit(float(16 ** 12))


def bucket_rank(df: DataFrame, by: list[str], bucket: Column, order: list, out: str = "rank",
                size: str | None = None) -> DataFrame:
    """Exact row_number within ``by``, with hot groups split into ordered buckets.

    A plain window would sort a whole group in one task. ``bucket`` must not decrease
    along ``order``; rows are ranked inside (by, bucket) and shifted by the running sum
    of bucket counts, which are aggregated map-side first. Only the counts meet in one
    window per group. ``size`` optionally names a column with the group's row count.
    """
    # One struct key: nulls inside it compare equal, and the window, the counts and the
    # join share its partitioning, so the rows are exchanged once.
    cut = df.withColumn("_key", F.struct(*by, bucket.cast("long").alias("_bucket")))
    inner = Window.partitionBy("_key").orderBy(*order)
    names = [f"_key.{c}" for c in by]
    group = Window.partitionBy(*names) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_key._bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (cut.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .withColumn("__size", F.sum("_n").over(group))
             .select("_key", "_offset", "__size"))
    joined = cut.withColumn("_inner", F.row_number().over(inner)).join(sizes, "_key")
    result = joined.withColumn(out, (F.col("_offset") + F.col("_inner")).cast("long"))
    if size:
        result = result.withColumn(size, F.col("__size").cast("long"))
    return result.drop("_key", "_offset", "__size", "_inner")


BUCKETS = 4096  # of value_bucket at most; beyond that each holds more rows


def splitters(df: DataFrame, column: str, parts: int) -> list:
    """Values that cut ``column`` into about ``parts`` parts of equally many rows, in order, without repeats.

    Numbers come from Spark's mergeable quantile sketch over all rows. Other types come from the rows
    whose hash falls below a bound, some 16 values for each part, strings up to their first 1024 characters. Splitters only decide where
    parts end; whatever they are, order is kept.
    """
    kind = df.schema[column].dataType
    if parts <= 1:
        return []
    if isinstance(kind, NumericType):
        shares = F.lit([k / parts for k in range(1, parts)])
        found = df.agg(F.percentile_approx(column, shares, F.lit(8 * parts))).first()[0] or []
        return sorted(set(found))
    every = max(1, df.count() // (16 * parts))
    lead = F.substring(column, 1, 1024) if isinstance(kind, StringType) else F.col(column)
    rows = df.where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(every)) == 0)).groupBy(
        lead.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    found, held, step = [], 0, sum(r.n for r in rows) / parts
    for r in sorted(rows, key=lambda r: r.v.encode() if isinstance(r.v, str) else r.v):
        if held >= step:
            found.append(r.v)
            held = 0
        held += r.n
    return found


def split_number(value: Column, cuts: list, kind: DataType) -> Column:
    """How many of the ordered ``cuts`` do not exceed ``value``, found in two steps; 0 for null."""
    if not cuts:
        return F.lit(0).cast("long")
    width = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[k:k + width] for k in range(0, len(cuts), width)]
    # One literal that is read once, cast back to the type of the column.
    texts = F.from_json(F.lit(json.dumps([[str(c) for c in chunk] for chunk in chunks])), "array<array<string>>")
    typed = texts.cast(f"array<array<{kind.simpleString()}>>")
    chunk = F.size(F.filter(F.transform(typed, lambda c: F.get(c, F.lit(0))), lambda x: x <= value)) - 1
    inside = F.size(F.filter(F.get(typed, chunk), lambda x: x <= value))
    return F.when(chunk >= 0, chunk * width + inside).otherwise(0).cast("long")


def value_bucket(df: DataFrame, column: str, rows: int = 20_000) -> Column:
    """Bucket number that never decreases along ``column``, about one bucket for ``rows`` rows.

    The buckets end at :func:`splitters`, so they are even for any distribution of numbers or strings;
    equal values share a bucket, nulls are in the first one.
    """
    buckets = min(BUCKETS, -(-df.count() // rows))
    return split_number(F.col(column), splitters(df, column, buckets), df.schema[column].dataType)


def spread_rank(df: DataFrame, by: list[str], digest: str, ties: list[str],
                out: str = "rank", buckets: int = 256, size: str | None = None) -> DataFrame:
    """:func:`bucket_rank` in order of a uniform hex digest: buckets are its leading bits."""
    lead = F.conv(F.substring(F.col(digest), 1, 4), 16, 10).cast("long")
    return bucket_rank(df, by, F.floor(lead * buckets / 65536), [digest, *ties], out, size)
