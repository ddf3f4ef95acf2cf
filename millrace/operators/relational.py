"""Scans, filters, projections, sorts, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of literal rows."""
    return spark.createDataFrame(rows, schema)


def point_lookup(df: DataFrame, column: str, key) -> DataFrame:
    """All rows of a key: an equality that the Parquet scan checks against its statistics."""
    return df.filter(F.col(column) == F.lit(key))


def range_scan(df: DataFrame, column: str, lo=None, hi=None, ordered: bool = True) -> DataFrame:
    """Rows with lo <= column <= hi (None: open), in order of the column."""
    if lo is not None:
        df = df.filter(F.col(column) >= F.lit(lo))
    if hi is not None:
        df = df.filter(F.col(column) <= F.lit(hi))
    return df.orderBy(column) if ordered else df


def prefix_scan(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose string starts with the prefix: pushed to the scan as StringStartsWith."""
    return df.filter(F.col(column).startswith(prefix))


def project_ordinals(df: DataFrame, places: list[int]) -> DataFrame:
    """Columns by position from 0; a position may repeat."""
    return df.select(*[F.col(df.columns[k]).alias(df.columns[k] if places.index(k) == i else f"{df.columns[k]}_{i}") for i, k in enumerate(places)])


def project_or_null(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by name; a name that ``df`` lacks becomes a column of nulls."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and null where b is zero."""
    return F.try_divide(a, b)


def truncated_divide(a: Column, b: Column) -> Column:
    """Integer division towards zero; null where b is zero."""
    return F.when(b != 0, F.call_function("div", a, b))


def sort(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Sort by (column, 'asc' | 'desc'); null is below every value."""
    return df.orderBy(*[F.asc_nulls_first(c) if d == "asc" else F.desc_nulls_last(c) for c, d in keys])


def top_k(df: DataFrame, keys: list[tuple[str, str]], k: int) -> DataFrame:
    """The first k rows of an order: one bounded heap a task, no full sort."""
    return sort(df, keys).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], keys: list[tuple[str, str]], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group: the rank limit is applied before the exchange as well."""
    order = [F.asc_nulls_first(c) if d == "asc" else F.desc_nulls_last(c) for c, d in keys]
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    return a.intersectAll(b) if every else a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    return a.exceptAll(b) if every else a.subtract(b)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows picked uniformly and repeatably: those whose seeded hash of ``key`` is least."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
