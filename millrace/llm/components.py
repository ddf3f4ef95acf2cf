"""Connected components of an edge table, by local union-find and alternating star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


class Forest:
    """Union-find with path halving; the least member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


#: Nodes that a task's union-find holds before it gives its stars out and starts anew.
HELD = 500_000


def _local(batches):
    def stars():
        nodes = [x for x in forest.up if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > HELD:
            yield stars()
            forest = Forest()
    yield stars()


def contract(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition as stars (a, b), a > b: fewer rows, the same components."""
    return edges.select("a", "b").mapInArrow(_local, "a long, b long")


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", name: str = "right") -> DataFrame:
    """``left`` joined to ``right``, which has one row a key.

    ``right`` is written first, so both sides are dealt for this join alone, and Spark
    splits the rows of a hot key over tasks where a partition is large (adaptive skew join).
    """
    return left.join(keep(right, name), on, how)


def disjoint(stars: DataFrame) -> bool:
    """Whether every node stands in one star alone: no node has two centres, and no centre is a node of another star."""
    return stars.groupBy("a").count().filter("count > 1").isEmpty() and stars.select("a").intersect(stars.select("b")).isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every node of the edges (a, b); a component is named by its least node.

    Each task contracts its edges to stars; large-star and small-star rounds (Kiveris et
    al., 2014) run on tables until the stars are disjoint, which is tested on the rows
    themselves. The rounds needed grow with the logarithm of the nodes. Rows that look up
    the centre of a star, of which a hub has any number, can be split over tasks.
    """
    now = keep(contract(edges.filter("a <> b")).distinct(), name)
    while not disjoint(now):
        # large star: a node goes to the least node of the neighbourhood of each lower neighbour
        least = now.union(now.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        centres = least.join(now.select("b").distinct(), "b", "left_semi")
        large = keep(split_join(now, centres, ["b"], name=f"{name}-centres").select("a", F.col("m").alias("b")).distinct(), f"{name}-large")
        # small star: a node and its lower neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = keep(contract(small).distinct(), name)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
