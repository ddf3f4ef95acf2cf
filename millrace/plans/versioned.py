"""Versioned tables: change logs read as of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(log: DataFrame, keys: list[str], version: str, until=None, inclusive: bool = True, deleted: Column | None = None) -> DataFrame:
    """The newest version of each key up to ``until`` (None: the latest), without deleted keys.

    One aggregate (the whole row travels with its version as a struct maximum), so there
    is map-side reduction and no sort of each key's versions.
    """
    if until is not None:
        log = log.filter(F.col(version) <= F.lit(until) if inclusive else F.col(version) < F.lit(until))
    rest = [c for c in log.columns if c not in keys and c != version]
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(version, *rest, gone.alias("__gone")), F.col(version)).alias("__v"))
    newest = newest.filter(~F.col("__v.__gone"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"__v.{c}").alias(c) for c in log.columns])


def dead_versions(log: DataFrame, keys: list[str], version: str, horizon) -> DataFrame:
    """Versions that no reader at or after ``horizon`` can see: those with a newer one at or before it."""
    seen = log.filter(F.col(version) <= F.lit(horizon)).groupBy(*keys).agg(F.max(version).alias("__kept"))
    return log.join(seen, keys).filter(F.col(version) < F.col("__kept")).drop("__kept")


def vacuum(log: DataFrame, keys: list[str], version: str, horizon) -> DataFrame:
    """The log without dead versions."""
    seen = log.filter(F.col(version) <= F.lit(horizon)).groupBy(*keys).agg(F.max(version).alias("__kept"))
    return log.join(seen, keys, "left").filter(F.col("__kept").isNull() | (F.col(version) >= F.col("__kept"))).select(*log.columns)


def conflicts(reads: DataFrame, commits: DataFrame, key: str, snapshot: str, committed: str) -> DataFrame:
    """Reads whose key was committed anew after their snapshot: those transactions must abort."""
    newest = commits.groupBy(key).agg(F.max(committed).alias("__c"))
    return reads.join(newest, key).filter(F.col("__c") > F.col(snapshot)).drop("__c")


def committed(log: DataFrame, commits: DataFrame, version: str) -> DataFrame:
    """The rows of a log whose version is among ``commits`` (one column of that name): what was rolled back is never read."""
    return log.join(commits.select(version).distinct(), version, "left_semi").select(*log.columns)
