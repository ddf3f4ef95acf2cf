"""Prepared statements, DML and schema changes as transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prepared(spark: SparkSession, sql: str) -> Callable[..., DataFrame]:
    """A statement with ? parameters, to be run with values; they never become part of the text, so they cannot change the statement."""
    return lambda *args: spark.sql(sql, args=list(args) or None)


def insert(table: DataFrame, rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``table`` with ``rows``: missing columns take their default, then null."""
    defaults = defaults or {}
    unknown = set(rows.columns) - set(table.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in table.schema])
    return table.unionByName(full)


def update(table: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """``table`` with new values in the rows where the condition is true (null is not); all read the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """``table`` without the rows where the condition is true."""
    return table.filter(F.lit(False) if where is None else ~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace the rows of equal keys and add the others: one full outer join on the keys."""
    t, r = table.alias("t"), rows.withColumn("__new", F.lit(True)).alias("r")
    joined = t.join(r, [F.col(f"t.{k}") == F.col(f"r.{k}") for k in keys], "full_outer")
    return joined.select(*[F.when(F.col("r.__new"), F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in table.columns])


def add_column(table: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    if name in table.columns:
        raise ValueError(f"column {name} exists")
    return table.withColumn(name, F.lit(default).cast(kind))


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    if old not in table.columns or new in table.columns:
        raise ValueError(f"cannot rename {old} to {new}")
    return table.withColumnRenamed(old, new)


def drop_column(table: DataFrame, name: str) -> DataFrame:
    if name not in table.columns:
        raise ValueError(f"no column {name}")
    return table.drop(name)


def row_level_filter(table: DataFrame, policy: str) -> DataFrame:
    """The rows that a policy (a SQL condition) lets a reader see."""
    return table.filter(F.expr(policy))
