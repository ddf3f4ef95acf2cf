"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, id), so copies stand together. Candidate key
boundaries (probes) are refined: each round counts the exact bytes and rows below every
probe across all partitions, and the bracket of each splitter shrinks to the interval
between two probes, until the count at one of them is within tolerance. Only then do
rows move, once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, small_batches, without

#: Keys are 128-bit: two signed longs, the first more significant.
SHIFT = 1 << 63
#: Probes in a bracket and round, and in a round.
FANOUT, MOST_PROBES = 16, 16_384
#: Rows of a part that is sorted on its own, about.
LANE = 1_000_000


def join_key(a: int, b: int) -> int:
    return (a + SHIFT) << 64 | (b + SHIFT)


def split_key(key: int) -> tuple[int, int]:
    return (key >> 64) - SHIFT, (key & (1 << 64) - 1) - SHIFT


def place(k1: np.ndarray, k2: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """For each key the number of probes that are not above it; probes are sorted."""
    lo, hi = np.searchsorted(p1, k1, "left"), np.searchsorted(p1, k1, "right")
    out, tied = lo.copy(), np.flatnonzero(lo < hi)
    for at in np.unique(lo[tied]):
        mine = tied[lo[tied] == at]
        out[mine] = at + np.searchsorted(p2[at : hi[mine[0]]], k2[mine], "right")
    return out


def _histogram(probes: list[int]):
    p = np.array([split_key(x) for x in probes], np.int64).reshape(-1, 2)

    def run(batches):
        n = len(p) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            k1, k2, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            at = place(k1, k2, p[:, 0], p[:, 1])
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=n)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x[some] if k else some) for k, x in enumerate((some, size, rows))], ["cell", "size", "n"])

    return run


def below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each of the sorted probes; one row a cell comes to the driver."""
    cells = keys.mapInArrow(_histogram(probes), "cell long, size long, n long").groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in cells:
        size[r["cell"]], rows[r["cell"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


@dataclass
class Bracket:
    """A splitter lies in (lo, hi]; size and rows below either end are known."""

    want: float
    slack: float
    lo: int
    hi: int
    lo_size: int
    hi_size: int
    lo_rows: int
    hi_rows: int

    def done(self) -> bool:
        return min(self.want - self.lo_size, self.hi_size - self.want) <= self.slack or self.hi - self.lo <= 1 or self.hi_rows - self.lo_rows <= 1

    def best(self) -> tuple[int, int]:
        """The better end, and the rows below it."""
        low = self.want - self.lo_size <= self.hi_size - self.want
        return (self.lo, self.lo_rows) if low else (self.hi, self.hi_rows)

    def probes(self, n: int) -> list[int]:
        step = (self.hi - self.lo) / n if self.hi - self.lo < 1 << 40 else None
        return [self.lo + (int(step * k) if step else (self.hi - self.lo) * k // n) for k in range(1, n)]


def splitters(keys: DataFrame, wants: list[float], slacks: list[float], total: int, rows: int, ends: tuple[int, int]) -> list[tuple[int, int]]:
    """(key, rows below it) for each wanted number of bytes below (rising), within its slack or as near as rows allow."""
    brackets = [Bracket(w, s, ends[0], ends[1] + 1, 0, total, 0, rows) for w, s in zip(wants, slacks, strict=True)]
    while open_ := [b for b in brackets if not b.done()]:
        alike = len({(b.lo, b.hi) for b in open_}) == 1
        n = min(MOST_PROBES, 4 * len(open_) + FANOUT) if alike else max(3, min(FANOUT, MOST_PROBES // len(open_)))
        probes = sorted({p for b in (open_[:1] if alike else open_) for p in b.probes(n) if b.lo < p < b.hi})
        if not probes:
            break
        size, count = below(keys, probes)
        for b in open_:
            k = int(np.searchsorted(size, b.want, "right"))  # the first probe with more below it than wanted
            if k and probes[k - 1] > b.lo:
                b.lo, b.lo_size, b.lo_rows = probes[k - 1], int(size[k - 1]), int(count[k - 1])
            if k < len(probes) and probes[k] < b.hi:
                b.hi, b.hi_size, b.hi_rows = probes[k], int(size[k]), int(count[k])
    found: list[tuple[int, int]] = []
    for b in brackets:  # two splitters in one bracket may pick its ends in either order
        found.append(max(b.best(), found[-1]) if found else b.best())
    return found


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """``docs`` with size, shard and slot.

    size is the UTF-8 length of the text (null: none) plus 1. Shards are ranges of the
    key (xxhash64 of the text, id); the bytes below each splitter differ from the even
    share by at most ``tolerance`` of a shard, or by half the one document that stands
    there. Rows of equal text and id have one key and stay together. slot counts the
    rows of a shard from 0 in key order (rows of one key: by nothing further). Columns
    of the added names in ``docs`` are replaced; an empty table gives an empty table. Ids
    are whole numbers, or strings of digits; a null id stands below all others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "size", "shard", "slot", "__k1", "__k2", "__lane")
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    docs = docs.withColumn("size", size).withColumn("__k1", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__k2", F.coalesce(F.col(id_col).cast("long"), F.lit(-SHIFT)))
    keys = keep(docs.select("__k1", "__k2", "size"), "keys")
    t = keys.agg(F.sum("size"), F.count("*"), F.min("__k1"), F.max("__k1")).first()
    total, rows = t[0] or 0, t[1]
    if not rows:
        return docs.drop("__k1", "__k2").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    # lanes cut each shard into parts for the one exchange; their edges need no accuracy
    lanes = shards * max(-(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards), -(-rows // (LANE * shards)))
    each = lanes // shards
    wants = [total * k / lanes for k in range(1, lanes)]
    slacks = [(tolerance * total / shards) if k % each == 0 else 0.25 * total / lanes for k in range(1, lanes)]
    cuts = splitters(keys, wants, slacks, total, rows, (join_key(t[2], -SHIFT), join_key(t[3], SHIFT - 1)))
    probes = np.array([split_key(c[0]) for c in cuts], np.int64).reshape(-1, 2)
    edges = [0, *(c[1] for c in cuts)]

    @F.pandas_udf("int")
    def lane(k1, k2):
        import pandas as pd

        return pd.Series(place(k1.to_numpy(), k2.to_numpy(), probes[:, 0], probes[:, 1]).astype(np.int32))

    starts = F.split(F.lit(",".join(str(edges[k] - edges[k // each * each]) for k in range(lanes))), ",").cast("array<long>")
    out = docs.withColumn("__lane", lane("__k1", "__k2"))
    rank = F.row_number().over(Window.partitionBy("__lane").orderBy("__k1", "__k2"))
    out = out.withColumn("shard", (F.col("__lane") / each).cast("int")).withColumn("slot", starts[F.col("__lane")] + rank - 1)
    return out.drop("__k1", "__k2", "__lane")
