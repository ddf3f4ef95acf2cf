"""Exact Jaccard links inside buckets of candidates, without emitting pairs.

1. Buckets are read off rows (key, id) of one range of keys after the other. A bucket of one member is nothing, and
   buckets of the same members (as different bands give them) are verified once. A larger
   bucket is cut into blocks in an order of its own, so that no task holds it.
2. In each block a search from member to member compares exact shingle sets: whoever is
   linked to a member already reached is compared no more. The blocks give the edges of
   their verified components, fewer than they have members. Small blocks are compared
   many at a time.
3. Members of different blocks of one bucket are compared only where the verified
   components differ: those outside the bucket's largest component against all others.

So a bucket of true copies costs its size, however large; only members that are unlike
each other and yet share a bucket are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components, split_join
from .store import keep
from .textkit import U, mix, signed

#: Members of a block.
BLOCK = 256
_SCHEMA = ["bucket", "big", "block", "id"]


class Buckets:
    """Reads rows (key, id) that stand in order of their keys, and gives (bucket, big, block, id).

    Equal rows count once, unless they fall into different blocks of a large bucket.
    """

    def __init__(self, block: int):
        self.block = block
        self.k, self.i, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the open bucket: what is held of it, and how many went out

    @staticmethod
    def _table(bucket, big, at, ids):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.full(n, big)), pa.array(at, pa.int32()), pa.array(ids, pa.int64())], _SCHEMA)

    def _whole(self, i, first, size):
        """Buckets of two members to ``block``, named by what is in them."""
        some = (size > 1) & (size <= self.block)
        if some.any():
            h = mix(i.view(U) ^ U(0x5DEECE66D))
            name = signed(mix(np.add.reduceat(h, first) * U(3) + size.astype(U)))
            on = np.repeat(some, size)
            yield self._table(np.repeat(name[some], size[some]), False, np.zeros(int(on.sum()), np.int32), i[on])

    def _large(self, key, i, at):
        name = signed(mix(np.array([key]).view(U) + U(11)))[0]
        yield self._table(np.full(len(i), name), True, ((at + np.arange(len(i))) // self.block).astype(np.int32), i)

    def push(self, keys: np.ndarray, ids: np.ndarray):
        k, i, at = np.concatenate((self.k, keys)), np.concatenate((self.i, ids)), self.at
        if len(k):
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            k, i = k[new], i[new]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            if at and len(first) > 1:  # the large bucket of the rows before ends here
                yield from self._large(k[0], i[: first[1]], at)
                k, i, at, first = k[first[1] :], i[first[1] :], 0, first[1:] - first[1]
            last = first[-1]
            if last:
                size = np.diff(np.append(first[:-1], last))
                yield from self._whole(i[:last], first[:-1], size)
                for f, n in zip(first[:-1][size > self.block].tolist(), size[size > self.block].tolist(), strict=True):
                    yield from self._large(k[f], i[f : f + n], 0)
                k, i = k[last:], i[last:]
            out = (len(i) - 1) // self.block * self.block if at or len(i) > self.block else 0  # one row stays, to tell repeats
            if out:
                yield from self._large(k[0], i[:out], at)
                k, i, at = k[out:], i[out:], at + out
        self.k, self.i, self.at = k, i, at

    def close(self):
        if self.at or len(self.i) > self.block:
            yield from self._large(self.k[0], self.i, self.at)
        elif len(self.i):
            yield from self._whole(self.i, np.zeros(1, np.int64), np.array([len(self.i)]))


#: Rows that are read at a time, about.
READ = 50_000


def gathered(batches, rows: int = READ):
    """Batches joined until they hold ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Rows are dealt over 2**PARTS ranges of keys, by their last bits; rows that a task packs at a time; rows of one range after which its large buckets go out.
PARTS, PACK, MANY = 12, 1_000_000, 4_000_000


def packed(pairs):
    """(part, rows) from arrays (keys, ids): the rows of a range of keys in one value, so that Spark moves hundreds of them as one row. Keys are hashes."""

    def out():
        k, i = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (k & ((1 << PARTS) - 1)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, rows = part[order], np.stack((k, i), 1)[order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = (np.append(first, len(part)) * 16).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(rows)])], ["part", "rows"])

    held, n = [], 0
    for keys, ids in pairs:
        for at in range(0, len(keys), PACK):
            held.append((keys[at : at + PACK], ids[at : at + PACK]))
            n += len(held[-1][0])
            if n >= PACK:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _unpacked(block: int):
    def run(batches):
        held, n, last, most, gone = [], 0, None, MANY, {}  # gone: how many went out of the large buckets of the open range

        def rows():
            """Keys and ids in order of the keys, without the keys of one row."""
            both = np.concatenate(held)
            k, i = np.ascontiguousarray(both[:, 0]), both[:, 1]
            order, k = sort_order(k.view(U))
            k = k.view(np.int64)
            same = k[1:] == k[:-1]
            on = np.append(same, False) | np.insert(same, 0, False)
            if gone:
                on |= np.isin(k, np.array(list(gone), np.int64))
            return k[on], i[order[on]]

        def whole():
            k, i = rows()
            if gone:
                rest = np.isin(k, np.array(list(gone), np.int64))
                for key in np.unique(k[rest]).tolist():
                    yield from reader._large(key, np.unique(i[k == key]), gone[key])
                k, i = k[~rest], i[~rest]
            yield from reader.push(k, i)
            yield from reader.close()

        def large():
            nonlocal held, n, most
            both = np.concatenate(held)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.append(True, (both[1:] != both[:-1]).any(1))]
            first = np.flatnonzero(np.append(True, both[1:, 0] != both[:-1, 0]))
            size = np.diff(np.append(first, len(both)))
            hot = size > block
            for f, c in zip(first[hot].tolist(), size[hot].tolist(), strict=True):
                key = int(both[f, 0])
                yield from reader._large(key, both[f : f + c, 1], gone.get(key, 0))
                gone[key] = gone.get(key, 0) + c
            held = [both[~np.repeat(hot, size)]]
            n = len(held[0])
            most = max(MANY, 2 * n)

        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != last and n and (n >= READ or gone):
                    reader = Buckets(block)
                    yield from whole()
                    held, n, most, gone = [], 0, MANY, {}
                last = part
                held.append(np.frombuffer(value.as_buffer(), np.int64).reshape(-1, 2))
                n += len(held[-1])
                if n > most:
                    reader = Buckets(block)
                    yield from large()
        if held:
            reader = Buckets(block)
            yield from whole()

    return run


def buckets(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, big, block, id): the buckets of two or more different ids, from ``packed`` rows (part, rows).

    A range of keys is read at a time; of a range of very many rows, those of large
    buckets go out as they come. A bucket of more than ``block`` members is ``big`` and
    cut into blocks.
    """
    laid = rows.select("part", "rows").repartition("part").sortWithinPartitions("part")
    return laid.mapInArrow(_unpacked(block), "bucket long, big boolean, block int, id long").distinct()


class Sets:
    """The sets of texts; overlaps of one with all that are left."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, rows: int):
        order, h = sort_order(hashes)
        row = row[order]
        other = np.ones(len(h), bool)
        other[1:] = h[1:] != h[:-1]
        code = np.cumsum(other) - 1
        other[1:] |= row[1:] != row[:-1]  # a shingle of a text counts once
        code, row = code[other], row[other]
        self.codes = code[np.argsort(row.astype(np.uint16) if rows < 1 << 16 else row, kind="stable")]
        self.size = np.bincount(row, minlength=rows)
        self.mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
        self.ends = np.cumsum(self.size)
        self.use(np.flatnonzero(self.size > 0))

    def own(self, x: int) -> np.ndarray:
        return self.codes[self.ends[x] - self.size[x] : self.ends[x]]

    def use(self, left: np.ndarray) -> None:
        """Compare with these members from now on."""
        self.left = left
        self.flat = np.concatenate([self.own(x) for x in left.tolist()]) if len(left) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size[left]) - self.size[left]

    def like(self, x: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the members in use that are linked to ``x``, and the similarities."""
        if not len(self.left) or not self.size[x]:
            return np.zeros(0, np.int64), np.zeros(0)
        self.mark[self.own(x)] = True
        both = np.add.reduceat(self.mark[self.flat], self.first, dtype=np.int64)
        self.mark[self.own(x)] = False
        union = self.size[x] + self.size[self.left] - both
        ok = (both >= threshold * union - 1e-9) & (both > 0)
        return self.left[ok], both[ok] / union[ok]


def tree(all_: Sets, threshold: float) -> list[tuple[int, int, float]]:
    """Edges (a, b, similarity) of a spanning forest of the links between the sets; empty sets link to none."""
    out, queue = [], []
    waits = all_.size > 0
    while waits.any():
        x = queue.pop() if queue else int(np.argmax(waits))
        waits[x] = False
        found, s = all_.like(x, threshold)
        fresh = waits[found]
        out += [(x, y, j) for y, j in zip(found[fresh].tolist(), s[fresh].tolist(), strict=True)]
        queue += found[fresh].tolist()
        waits[found] = False
        if 2 * int(waits.sum()) <= len(all_.left):
            all_.use(np.flatnonzero(waits))
    return out


def _grouped(batches, keys: int):
    """(key values, rows) for each run of rows with equal values in the first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _edges(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])


#: Members up to which all pairs of a block are compared, many blocks at a time; characters of text that are gathered for that.
SMALL, GATHER = 8, 100_000


def sort_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of hashes, and the hashes in it: their first bits are sorted with the places behind them, which is faster than sorting places."""
    bits = U(max(1, len(key)).bit_length())
    packed = key >> bits
    packed <<= bits
    packed |= np.arange(len(key), dtype=U)
    packed.sort()
    order = (packed & ((U(1) << bits) - U(1))).view(np.int64)
    packed >>= bits
    whole = key[order]
    if ((packed[1:] == packed[:-1]) & (whole[1:] != whole[:-1])).any():  # different hashes of equal first bits
        order = np.argsort(key, kind="stable")
        return order, key[order]
    return order, whole


#: Which pairs of SMALL rows a mask holds.
_BOTH = ((np.arange(1 << SMALL)[:, None] >> np.arange(SMALL) & 1)[:, :, None] * (np.arange(1 << SMALL)[:, None] >> np.arange(SMALL) & 1)[:, None, :]).reshape(1 << SMALL, SMALL * SMALL)


def small_links(hashes: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, threshold: float):
    """Linked pairs (row a, row b, similarity) of many small blocks at once.

    hashes, row: shingles of all rows, row after row; first, n: the rows first to
    first + n - 1 are a block.
    """
    count = np.bincount(row, minlength=int(n.sum()))
    block = np.repeat(np.arange(len(n)), n)
    key = hashes ^ np.repeat(mix(block.astype(U) + U(1)), count)  # equal shingles of different blocks differ
    order, key = sort_order(key)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # each different shingle of a block has a mask of the rows that hold it; a block's masks are counted
    bit = np.repeat((1 << np.arange(len(block)) - first[block]).astype(np.uint8), count)
    mask = np.bitwise_or.reduceat(bit[order], start)
    held = np.bincount(np.repeat(block << SMALL, count)[order[start]] + mask, minlength=len(n) << SMALL)
    cell = np.flatnonzero(held)
    at = np.flatnonzero(np.concatenate(([True], cell[1:] >> SMALL != cell[:-1] >> SMALL)))
    both = np.zeros((len(n), SMALL * SMALL), np.int64)
    both[cell[at] >> SMALL] = np.add.reduceat(_BOTH[cell & (1 << SMALL) - 1] * held[cell, None], at, axis=0)
    both = both.reshape(len(n), SMALL, SMALL)
    size = np.diagonal(both, axis1=1, axis2=2)
    u, a, b = np.nonzero(np.triu(both, 1))
    both = both[u, a, b]
    union = size[u, a] + size[u, b] - both
    ok = both >= threshold * union - 1e-9
    return (first[u] + a)[ok], (first[u] + b)[ok], both[ok] / union[ok]


def _in_blocks(shingle: Callable, threshold: float):
    def small(units):
        """Forest edges of blocks of at most SMALL rows."""
        rows = [r for unit in units for r in unit]
        n = np.array([len(unit) for unit in units])
        forest, at = Forest(), np.cumsum(n) - n
        found = small_links(*shingle([r[1] for r in rows]), at, n, threshold)
        return [(rows[a][0], rows[b][0], s) for a, b, s in zip(*(x.tolist() for x in found), strict=True) if forest.join(a, b)]

    def run(batches):
        out, units, held = [], [], 0
        for _, rows in _grouped(batches, 2):
            if 1 < len(rows) <= SMALL:
                units.append(rows)
                held += sum(len(r[1]) for r in rows)
            elif len(rows) > SMALL:
                out += [(rows[x][0], rows[y][0], s) for x, y, s in tree(Sets(*shingle([r[1] for r in rows]), len(rows)), threshold)]
            if held > GATHER:
                out += small(units)
                units, held = [], 0
            if len(out) > 20_000:
                yield _edges(out)
                out = []
        yield _edges(out + small(units) if units else out)

    return run


def _across(shingle: Callable, threshold: float):
    """Links between a block of all members (side 0) and one of those outside the largest component (side 1)."""

    def run(batches):
        out = []
        for _, rows in _grouped(batches, 3):
            sets, forest = Sets(*shingle([r[3] for r in rows]), len(rows)), Forest()
            side = np.array([r[0] for r in rows])
            if side.all() or not side.any():
                continue
            sets.use(np.flatnonzero((side == 0) & (sets.size > 0)))
            for x in np.flatnonzero(side == 1).tolist():
                for y, s in zip(*(v.tolist() for v in sets.like(x, threshold)), strict=True):
                    if forest.join(rows[x][1], rows[y][1]):
                        out.append((rows[x][2], rows[y][2], s))
            if len(out) > 20_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def linked(members: DataFrame, texts: DataFrame, shingle: Callable, threshold: float, block: int = BLOCK, name: str = "links") -> DataFrame:
    """Edges (a, b, similarity) that join whatever members of one bucket are linked, directly or through other members.

    ``members``: (bucket, big, block, id) as ``buckets`` gives them, with ids that occur
    once in ``texts`` (id, text). ``shingle``: texts -> (hashes of all
    their shingles, text after text; the number of the text of each).
    """
    laid = members.join(texts, "id").select("bucket", "block", "id", "text").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    edges = keep(laid.mapInArrow(_in_blocks(shingle, threshold), "a long, b long, similarity double"), name)
    big = members.filter("big")
    if big.isEmpty():
        return edges
    found = components(edges, name).withColumnRenamed("component", "group")
    big = keep(big.select("bucket", "id").join(found, "id", "left").withColumn("group", F.coalesce("group", "id")), f"{name}-big")
    sizes = big.groupBy("bucket", "group").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.max(F.struct("count", "group")).alias("most"))
    sizes = keep(sizes.filter(F.col("n") > F.col("most.count")).select("bucket", F.col("most.group").alias("most"), F.ceil(F.col("n") / block).alias("all_blocks"), F.ceil((F.col("n") - F.col("most.count")) / block).alias("other_blocks")), f"{name}-mixed")
    if sizes.isEmpty():
        return edges
    part = big.join(sizes, "bucket")
    h = F.xxhash64("id", F.lit(5))
    every = part.withColumn("i", F.pmod(h, "all_blocks")).withColumn("j", F.explode(F.expr("sequence(0L, other_blocks - 1)"))).withColumn("side", F.lit(0))
    other = part.filter(F.col("group") != F.col("most")).withColumn("j", F.pmod(h, "other_blocks")).withColumn("i", F.explode(F.expr("sequence(0L, all_blocks - 1)"))).withColumn("side", F.lit(1))
    both = every.unionByName(other).join(texts, "id").select("bucket", "i", "j", "side", "group", "id", "text")
    laid = both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = keep(laid.mapInArrow(_across(shingle, threshold), "a long, b long, similarity double"), f"{name}-across")
    return edges.union(more)


def _count(shingle: Callable, threshold: float):
    def run(batches):
        out = []
        for (_, i, j), rows in _grouped(batches, 3):
            weight, block = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            sets = Sets(*shingle([r[3] for r in rows]), len(rows))
            links, heavy = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            if i != j:
                sets.use(np.flatnonzero(block == i))
            for x in np.flatnonzero(block == j).tolist():
                got = sets.like(x, threshold)[0]
                got = got[got < x] if i == j else got
                links[got] += 1
                heavy[got] += weight[x]
                links[x] += len(got)
                heavy[x] += int(weight[got].sum())
            out += [(rows[k][0], int(links[k]), int(heavy[k])) for k in np.flatnonzero(links).tolist()]
            if len(out) > 20_000:
                yield _counts(out)
                out = []
        yield _counts(out)

    def _counts(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["id", "links", "weight"])

    return run


def counted(classes: DataFrame, texts: DataFrame, shingle: Callable, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links, weight): how many others of its class each id is linked to, and the sum of their weights.

    ``classes``: (id, component, weight); ``texts``: (id, text), an id once. All pairs of a
    class are compared, which is what counting its links takes: a class is cut into blocks,
    and each pair of blocks is a unit of its own, so no task holds a class.
    """
    sizes = classes.groupBy("component").count().filter(F.col("count") > block).select("component", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cut = split_join(classes, sizes, ["component"], "left", "sizes").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = cut.select("id", "component", "weight", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    laid = each.join(texts, "id").select("component", "i", "j", "id", "weight", "block", "text").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return laid.mapInArrow(_count(shingle, threshold), "id long, links long, weight long").groupBy("id").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
