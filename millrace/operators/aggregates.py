"""Aggregation: global, by groups, and in two explicit steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}


def aggregate(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, str]], having: Column | None = None) -> DataFrame:
    """measures: name -> (function, column or '*'). Null keys form a group; no keys give one row."""
    made = [(F.count(F.lit(1)) if c == "*" else FUNCTIONS[f](F.col(c))).alias(n) for n, (f, c) in measures.items()]
    out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return out if having is None else out.filter(having)


def partial(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mergeable state of a column by group: n, s, lo, hi."""
    return df.groupBy(*keys).agg(F.count(column).alias("n"), F.sum(column).alias("s"), F.min(column).alias("lo"), F.max(column).alias("hi"))


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of the same groups merged into one."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def finish(states: DataFrame) -> DataFrame:
    """count, sum, avg, min and max from merged states."""
    return states.select(*[c for c in states.columns if c not in ("n", "s", "lo", "hi")], F.col("n").alias("count"), F.col("s").alias("sum"), F.try_divide("s", "n").alias("avg"), F.col("lo").alias("min"), F.col("hi").alias("max"))


def salted(df: DataFrame, keys: list[str], column: str, salts: int = 32) -> DataFrame:
    """partial + merge over salted keys, for functions whose partial form does not shrink hot groups."""
    spread = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(column)), F.lit(salts)))
    return merge(partial(spread, [*keys, "__salt"], column), keys)
