"""Shard routing, balance, and map-reduce fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_shard(key: Column, shards: int) -> Column:
    """Key modulo shards for whole numbers: the same in every engine."""
    return F.pmod(key.cast("long"), F.lit(shards)).cast("long")


def range_shard(key: Column, bounds: list) -> Column:
    """The number of bounds that are not above the key: half-open ranges, so a bound is in one shard only."""
    return reduce(lambda a, b: a + F.when(key >= F.lit(b), 1).otherwise(0), bounds, F.lit(0)).cast("long")


def consistent_shard(key: Column, shards: int) -> Column:
    """Rendezvous hashing: the shard of the greatest hash; one shard more takes keys only into itself."""
    scores = F.array(*[F.struct(F.xxhash64(key, F.lit(k)).alias("h"), F.lit(k).cast("long").alias("k")) for k in range(shards)])
    return F.array_max(scores)["k"]


def shard_counts(df: DataFrame, shard: Column) -> DataFrame:
    return df.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


def balance(counts: DataFrame) -> DataFrame:
    """shards, smallest, largest and whether they differ by one row at most."""
    return counts.agg(F.count(F.lit(1)).alias("shards"), F.min("rows").alias("smallest"), F.max("rows").alias("largest"), (F.max("rows") - F.min("rows") <= 1).alias("balanced"))


def rebalance(df: DataFrame, shards: int, key: str) -> DataFrame:
    """Rows dealt anew by key; equal keys stay together."""
    return df.repartition(shards, key)


def fragments(df: DataFrame, shard: Column, keys: list[str], measures: list[Column]) -> DataFrame:
    """A grouped aggregate of each shard: one pass over the table, grouped by the shard as well."""
    return df.groupBy(shard.alias("shard"), *keys).agg(*measures)
