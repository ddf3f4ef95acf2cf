"""Constraint checks and referential actions, as anti joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("restrict", "no action", "cascade", "set null", "set default")


class Violation(ValueError):
    """Rows break a constraint."""


def duplicates(df: DataFrame, keys: list[str], primary: bool = False) -> DataFrame:
    """Keys of more than one row with their count; UNIQUE lets null keys repeat, PRIMARY KEY does not let them be."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    null = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    return found.filter((F.col("occurrences") > 1) | null) if primary else found.filter((F.col("occurrences") > 1) & ~null)


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: the rows in which it is null."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])))


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows in which the condition is false; unknown passes."""
    return df.filter(~F.coalesce(condition, F.lit(True)))


def fk_violations(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Child rows (with no null in the key) without a parent."""
    keys = parent.select(*[F.col(p).alias(f"__p{k}") for k, (_, p) in enumerate(on)])
    some = child.dropna(subset=[c for c, _ in on])
    return some.join(keys, [F.col(c) == F.col(f"__p{k}") for k, (c, _) in enumerate(on)], "left_anti")


def delete_parents(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]], where: Column, action: str = "restrict", defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(parent, child) after the parents under ``where`` are deleted.

    restrict and no action raise Violation if a deleted parent has children; cascade
    deletes them; set null and set default write null or the default into their keys.
    """
    if action not in ACTIONS:
        raise ValueError(f"no action {action!r}")
    hit = F.coalesce(where, F.lit(False))
    left = parent.filter(~hit)
    gone = parent.filter(hit).select(*[F.col(p).alias(f"__p{k}") for k, (_, p) in enumerate(on)]).distinct()
    match = [F.col(c) == F.col(f"__p{k}") for k, (c, _) in enumerate(on)]
    if action in ("restrict", "no action"):
        if not child.join(gone, match, "left_semi").isEmpty():
            raise Violation("a parent that is to be deleted has children")
        return left, child
    if action == "cascade":
        return left, child.join(gone, match, "left_anti")
    marked = child.join(gone.withColumn("__gone", F.lit(True)), match, "left")
    defaults = defaults or {}
    keys = {c for c, _ in on}
    new = lambda f: F.lit(defaults.get(f.name) if action == "set default" else None).cast(f.dataType)
    return left, marked.select(*[F.when(F.col("__gone"), new(f)).otherwise(F.col(f.name)).alias(f.name) if f.name in keys else F.col(f.name) for f in child.schema])


def enforce(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df``, or Violation if there are any rows in ``violations``."""
    if not violations.isEmpty():
        raise Violation(message)
    return df
