"""Joins of every type, with a selectable physical strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HINTS = {"auto": None, "broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}
TYPES = {"inner": "inner", "left": "left_outer", "right": "right_outer", "full": "full_outer", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: Column | list[tuple[str, str]], how: str = "inner", strategy: str = "auto", null_safe: bool = False) -> DataFrame:
    """Join on a condition or on pairs of columns (left, right).

    Outer rows are padded with nulls. Null keys match nothing unless ``null_safe``. The
    strategy is a hint: results are the same under each.
    """
    if not isinstance(on, Column):
        on = [F.col(f"l.{a}").eqNullSafe(F.col(f"r.{b}")) if null_safe else F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in on]
        left, right = left.alias("l"), right.alias("r")
    hint = HINTS[strategy]
    return left.join(right.hint(hint) if hint else right, on, TYPES[how])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join on any condition. Without an equality in it every pair is looked at."""
    return left.join(right, condition, TYPES[how])


def range_join(left: DataFrame, right: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs with lo <= point <= hi by cells of ``width``: an equality join on cells, so no pair outside a cell is looked at.

    Each interval is repeated once for every cell that it touches; choose a width near
    that of typical intervals.
    """
    cells = right.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return left.withColumn("__cell", F.floor(F.col(point) / width)).join(cells, "__cell").filter(F.col(point).between(F.col(lo), F.col(hi))).drop("__cell")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the newest row of ``right`` of equal keys and a time at or before its own (null if there is none).

    Both sides meet in one exchange on the keys and one sort by time; no pair is looked
    at. Rows of ``right`` that tie in keys and time count by their columns, the greatest last.
    """
    found = F.struct(*[F.col(c).alias(c) for c in columns])
    kind = right.select(found.alias("f")).schema["f"].dataType
    a = left.withColumn("__side", F.lit(1)).withColumn("__found", F.lit(None).cast(kind))
    b = right.select(*keys, time, F.lit(0).alias("__side"), found.alias("__found"))
    w = Window.partitionBy(*keys).orderBy(time, "__side", "__found").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__newest", F.last("__found", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*left.columns, *[F.col(f"__newest.{c}").alias(c) for c in columns])


def interval_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of overlapping intervals (ends included): an equality join on cells of ``width``, each pair in the first cell that both touch."""
    cell = lambda c: F.floor(F.col(c) / width)
    x = left.withColumn("__cell", F.explode(F.sequence(cell(a[0]), cell(a[1]))))
    y = right.withColumn("__cell", F.explode(F.sequence(cell(b[0]), cell(b[1]))))
    met = x.join(y, "__cell").filter((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    return met.filter(F.col("__cell") == F.greatest(cell(a[0]), cell(b[0]))).drop("__cell")
