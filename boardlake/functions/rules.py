"""Rule tables: named boolean columns to violation rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(problems: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds or cannot be decided (null): rules fail closed."""
    return F.array_compact(F.array(*[F.when(~c.eqNullSafe(F.lit(False)), F.lit(n)) for n, c in problems.items()]))


def violations(df: DataFrame, keys: Sequence[str], problems: Mapping[str, Column]) -> DataFrame:
    """One row per key and broken rule; a null condition counts as broken."""
    return df.select(*keys, F.explode(broken(problems)).alias("problem"))


def differs(a: Column | str, b: Column | str) -> Column:
    """Null-safe inequality."""
    x = F.col(a) if isinstance(a, str) else a
    y = F.col(b) if isinstance(b, str) else b
    return ~x.eqNullSafe(y)
