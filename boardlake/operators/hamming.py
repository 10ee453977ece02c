"""Exact search for grids that differ in few squares.

If two grids differ in at most r of the 64 squares, then of r + 1 disjoint segments at least one is equal in both. The
segments are diagonals of squares, one square of each rank and file, because whole ranks are empty too
often. The radius grows from 1 over 3 to 7; a grid whose best candidate lies within the radius is settled, ties
included, and only the others are asked again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.constants import SYMBOLS

SEGMENTS = (2, 4, 8)  # radius: one less
WORDS = 8  # a grid as eight numbers of 32 bits, four bits a square
NIBBLES = 0x11111111


def with_words(df: DataFrame, grid: str) -> DataFrame:
    """Add ``_w0`` to ``_w7``: the squares as numbers, eight at a time."""
    digits = F.translate(F.col(grid), SYMBOLS, "0123456789abc"[:len(SYMBOLS)])
    return df.withColumns({f"_w{k}": F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(WORDS)})


def differing(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squares in which two grids differ, from their words."""
    total = F.lit(0)
    for x, y in zip(a, b):
        bits = x.bitwiseXOR(y)
        for shift in (2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        total = total + F.bit_count(bits.bitwiseAND(F.lit(NIBBLES)))
    return total.cast("long")


def diagonals(grid: Column) -> list[Column]:
    """Eight disjoint segments of eight squares."""
    return [F.concat(*[F.substring(grid, 8 * rank + (rank + d) % 8 + 1, 1) for rank in range(8)]) for d in range(8)]


def _segments(df: DataFrame, count: int, keep: Sequence[str]) -> DataFrame:
    """One row for each segment: its number and symbols, and all segments for the check which one is the first."""
    size = 8 // count
    parts = F.array(*[F.concat(*[F.col(f"_d{count_ * size + k}") for k in range(size)]) for count_ in range(count)])
    return df.select(*keep, parts.alias("parts")).select(*keep, "parts", F.posexplode("parts").alias("at", "segment"))


def prepared(df: DataFrame, grid: str) -> DataFrame:
    """Words and diagonals of distinct grids."""
    return with_words(df, grid).withColumns({f"_d{k}": d for k, d in enumerate(diagonals(F.col(grid)))})


def near_grids(asked: DataFrame, known: DataFrame, grid: str, count: int) -> DataFrame:
    """(grid, distance, n, first) of prepared grids with a known one that differs in fewer than ``count`` squares.

    ``known`` has ``_n`` samples and the smallest id ``_first`` of each distinct grid. A pair that agrees in several segments
    counts at the first of them. Only sums for each asked grid and distance leave the join.
    """
    words = [f"_w{k}" for k in range(WORDS)]
    left = _segments(asked, count, [grid, *words])
    right = _segments(known, count, ["_n", "_first", *words]).withColumnsRenamed(
        {**{w: f"{w}b" for w in words}, "parts": "others"})
    pairs = left.join(right, ["at", "segment"])
    first = F.array_position(F.zip_with("parts", "others", lambda a, b: a == b), F.lit(True)) == F.col("at") + 1
    distance = differing([F.col(w) for w in words], [F.col(f"{w}b") for w in words])
    return pairs.where(first).withColumn("distance", distance).where(F.col("distance") < count).groupBy(
        grid, "distance").agg(F.sum("_n").alias("n"), F.min("_first").alias("first"))
