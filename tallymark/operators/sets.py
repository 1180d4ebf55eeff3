"""Set operations over key sets and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surviving(fired: Column, again: Column) -> Column:
    """Rules that fired and fire again, sorted."""
    return F.array_sort(F.array_intersect(fired, again))


def either(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()


def both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def unknown_keys(metadata: Column, allowed: tuple[str, ...]) -> Column:
    return F.array_except(F.map_keys(metadata), F.array(*[F.lit(k) for k in allowed]))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))
