"""A Bloom filter of bounded size over longs: a row filter ahead of an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import U, mix

#: Bits of the largest filter (8 MB). Beyond some 8 million members it lets more rows pass; the exact join behind it stays right.
MOST_BITS = 26


def _at(x: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(x.astype(np.int64).view(U))
    return [(h >> U(k * bits)) & U((1 << bits) - 1) for k in (0, 1)]


def member_test(members: DataFrame, n: int, column: str):
    """A function of an array of longs, for use in tasks: true for every value in ``members[column]`` (of which there are about ``n``)."""
    bits = min(MOST_BITS, max(10, int(16 * max(n, 1)).bit_length()))

    @F.pandas_udf("array<long>")
    def places(s):
        import pandas as pd

        a, b = _at(s.to_numpy(np.int64), bits)
        return pd.Series(list(np.stack((a, b), 1).astype(np.int64)), dtype=object)

    spot = members.select(F.explode(places(F.col(column))).alias("p"))
    words = spot.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).toPandas()
    table = np.zeros(1 << max(bits - 6, 0), U)
    table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(U)
    held = members.sparkSession.sparkContext.broadcast(table)

    def test(x: np.ndarray) -> np.ndarray:
        a, b = _at(x, bits)
        t = held.value
        return (t[(a >> U(6)).astype(np.int64)] >> (a & U(63)) & t[(b >> U(6)).astype(np.int64)] >> (b & U(63)) & U(1)).astype(bool)

    return test


def may_contain(members: DataFrame, n: int, column: str):
    """A function Column -> Column that is true for every value in ``members[column]`` (of which there are about ``n``)."""
    holds = member_test(members, n, column)

    @F.pandas_udf("boolean")
    def test(s):
        import pandas as pd

        return pd.Series(holds(s.fillna(0).to_numpy(np.int64)) & s.notna().to_numpy())

    def apply(c: Column) -> Column:
        return test(c)

    return apply
