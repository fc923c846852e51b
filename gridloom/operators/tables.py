"""Row-wise table operators: projection, predicate and join."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()])


def filter_all(df: DataFrame, predicate: Callable[[Column], Column], columns: list[str]) -> DataFrame:
    """Rows whose columns all pass; the predicate reaches the scan."""
    return df.filter(reduce(lambda a, b: a & b, [predicate(F.col(c)) for c in columns]))


def inner_join(left: DataFrame, right: DataFrame, on: str | list[str], right_unique: bool = False) -> DataFrame:
    """An equi-join; ``right_unique`` keeps one row a key of the right side, whichever sorts first."""
    if right_unique:
        keys = [on] if isinstance(on, str) else on
        rest = [c for c in right.columns if c not in keys]
        right = right.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else right.distinct()
    return left.join(right, on)
