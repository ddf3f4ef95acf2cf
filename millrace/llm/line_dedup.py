"""Fuzzy deduplication of lines: character shingles, MinHash, banding, exact Jaccard, union-find.

1. Each line's character shingles give a one-permutation MinHash signature; its bands are
   the keys of buckets. Buckets of several different lines are candidates.
2. Inside each bucket lines are verified on exact shingle sets (see ``verify``); buckets
   of the same lines are verified once.
3. Distributed union-find over verified links, joined with exact copies, gives the
   classes. The first line of each class, by document and line number, stays.

A line is known by 128 bits of its bytes; bands carry the first 64 of them, which may
only add candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import may_contain, member_test
from .components import components, split_join
from .store import keep, small_batches, without
from .textkit import CHUNK, band_keys, char_shingles, chunks, one_permutation, signed
from .verify import buckets, linked, packed

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 16, 6, 0.8
#: Lines that a task remembers to have seen; it forgets them all when there are more.
SEEN = 200_000


#: Unicode White_Space, as Java's (?U)\\s has it.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def line_key(line: str) -> tuple[int, int]:
    """128 bits of a line as two signed longs."""
    d = xxhash.xxh3_128_intdigest(line.encode("utf-8", "replace"))
    lo, hi = d & (1 << 64) - 1, d >> 64
    return lo - (lo >> 63 << 64), hi - (hi >> 63 << 64)


def _occurrences(holds):
    """(h1, h2, doc, digest, line, text) of every line with a character that is not white space, and a row of line -1 for each text.

    text: that of a line whose first 64 bits ``holds``, at its first place in the task; else null.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out, texts = [], []
            for doc, digest, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out.append((0, 0, doc, digest, -1))
                texts.append(None)
                for k, x in enumerate(split_lines(text)):
                    if x.strip(BLANK):
                        out.append((*line_key(x), doc, digest, k))
                        texts.append(x)
            made = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5
            on = holds(made[0].to_numpy()) & (made[4].to_numpy() >= 0)
            left: list[str | None] = [None] * len(out)
            for k in np.flatnonzero(on).tolist():
                if out[k][:2] not in seen:
                    seen.add(out[k][:2])
                    left[k] = texts[k]
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([*made, pa.array(left, pa.string())], ["h1", "h2", "doc", "digest", "line", "text"])

    return run


def _bands(size: int, bands: int, rows: int):
    """Packed (band key, first 64 bits) of the lines."""

    def run(batches):
        seen: set[int] = set()  # a common line of a task moves once, not once a copy
        for batch in batches:
            for _, _, b, off in chunks(batch.column(0), CHUNK // 2):
                texts = b.tobytes().decode("utf-8", "replace")
                codes = np.frombuffer(texts.encode("utf-32-le"), np.uint32)
                at = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))[off]  # rows in code points
                starts, ends, keys = [], [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for line in split_lines(texts[lo:hi]):
                        if line.strip(BLANK) and (h := line_key(line)[0]) not in seen:
                            seen.add(h)
                            starts.append(lo)
                            ends.append(lo + len(line))
                            keys.append(h)
                        lo += len(line) + 1
                if len(seen) > SEEN:
                    seen.clear()
                if not keys:
                    continue
                h, line = char_shingles(codes, np.array(starts), np.array(ends), size)
                band = band_keys(one_permutation(h, line, len(keys), bands * rows), bands, rows)
                yield signed(band.ravel()), np.repeat(np.array(keys, np.int64), bands)

    return lambda batches: packed(run(batches))


def shingles_of(size: int):
    """Texts -> (shingle hashes, the number of the text of each)."""

    def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        return char_shingles(codes, ends - [len(t) for t in texts], ends, size)

    return flat


def _remaining():
    """Each text that loses lines without these (null: it stays), and the number of lines with a visible character of every text."""

    @F.pandas_udf("text string, n_lines int")
    def remaining(texts, removed):
        import pandas as pd

        left, n = [], []
        for text, gone in zip(texts, removed, strict=True):
            lines = split_lines(text) if text else []
            n.append(sum(1 for x in lines if x.strip(BLANK)))
            gone = None if gone is None else set(gone)
            left.append(None if gone is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
        return pd.DataFrame({"text": pd.Series(left, dtype=object), "n_lines": pd.Series(n, dtype="int32")})

    return remaining


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    r"""``docs`` with each text reduced to the lines that are the first of their class.

    Lines are split at \\n; two lines are linked if they are equal or if the Jaccard
    similarity of their sets of ``size``-character shingles is ``threshold`` or more, and
    classes are the connected components. Lines of white space are no lines: they always
    stay. Order is by id (nulls first), then a hash of the text, then the line number.

    Adds n_lines, n_kept (lines with a visible character) and removed, an array of
    (line, class_id, kept_doc, kept_line). Null and empty texts pass unchanged with 0
    lines. Rows with equal id and text are copies: the first keeps its lines, the others
    lose them all. Ids are whole numbers, or strings of digits. A text of any length is
    worked on whole, in a chunk of its own. Columns of the added names in ``docs`` are
    replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "n_lines", "n_kept", "removed", "__doc", "__digest", "__copy", "__left")
    docs = docs.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn("__digest", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    some = docs.filter(F.length(text_col) > 0)
    members = keep(buckets(some.select(text_col).mapInArrow(_bands(size, bands, rows), "part int, rows binary")), "buckets")

    # every line, with the text of each candidate
    ids = members.select(F.col("id").alias("h1")).distinct()
    holds = member_test(ids, ids.count(), "h1")
    found = keep(some.select("__doc", "__digest", text_col).mapInArrow(_occurrences(holds), "h1 long, h2 long, doc long, digest long, line long, text string"), "lines")
    lines = found.filter("line >= 0").drop("text")
    texts = found.filter("text is not null").select("h1", "h2", "text").join(ids, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("text").alias("text"))
    texts = keep(texts.withColumn("id", F.monotonically_increasing_id()), "texts")  # written: an id of 64 bits for each line of 128
    nodes = texts.select("h1", "h2", F.col("id").alias("node"))
    members = members.join(nodes, F.col("id") == F.col("h1")).select("bucket", "big", "block", F.col("node").alias("id"))
    edges = linked(members, texts.select("id", "text"), shingles_of(size), threshold, name="lines")
    near = components(edges.select("a", "b"), "classes").join(nodes, F.col("id") == F.col("node")).select("h1", "h2", F.col("component").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(True).alias("near"))

    # classes: components, and lines that only have copies; a line of neither has nothing to remove
    copies = lines.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2", F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.lit(False).alias("near"))
    marked = near.unionByName(copies).groupBy("h1", "h2").agg(F.max(F.struct("near", "c1", "c2")).alias("c")).select("h1", "h2", "c.*")
    # a line may stand in a third of all documents: its rows can be split over tasks
    placed = keep(split_join(lines, marked, ["h1", "h2"], name="marked"), "placed")
    heads = placed.groupBy("near", "c1", "c2").agg(F.min(F.struct("doc", "digest", "line")).alias("head"), F.min("h1").alias("class_id"))
    gone = split_join(placed, heads, ["near", "c1", "c2"], name="heads").filter(F.struct("doc", "digest", "line") != F.col("head"))
    gone = gone.select("doc", "digest", F.struct("line", "class_id", F.col("head.doc").alias("kept_doc"), F.col("head.line").alias("kept_line")).alias("x"))
    again = found.filter("line < 0").groupBy("doc", "digest").count().filter("count > 1").select("doc", "digest", F.lit(None).cast(gone.schema["x"].dataType))
    gone = gone.union(again)
    gone = keep(gone.groupBy("doc", "digest").agg(F.array_sort(F.array_distinct(F.collect_list("x"))).alias("removed")), "gone")

    # only documents that lose a line move; the filter in front is of bounded size
    touched = may_contain(gone, gone.count(), "digest")(F.col("__digest"))
    docs = docs.withColumn("__hit", touched & (F.length(text_col) > 0))
    same = docs.filter("not coalesce(__hit, false)").withColumn("removed", F.lit(None).cast(gone.schema["removed"].dataType)).withColumn("__copy", F.lit(1))
    moved = docs.filter("__hit").join(gone.select(F.col("doc").alias("__d"), F.col("digest").alias("__g"), "removed"), (F.col("__doc") == F.col("__d")) & (F.col("__digest") == F.col("__g")), "left").drop("__d", "__g")
    moved = moved.withColumn("__copy", F.row_number().over(Window.partitionBy("__doc", "__digest").orderBy("__digest")))
    out = same.unionByName(moved)
    out = out.withColumn("__left", _remaining()(F.col(text_col), F.col("removed.line"))).withColumn("n_lines", F.col("__left.n_lines"))
    copy = F.col("__copy") > 1
    out = out.withColumn("n_kept", F.when(copy, F.lit(0)).otherwise(F.col("n_lines") - F.coalesce(F.size("removed"), F.lit(0))))
    left = F.when(copy, F.lit("")).when(F.col("removed").isNotNull(), F.col("__left.text")).otherwise(F.col(text_col))
    return out.withColumn(text_col, left).withColumn("removed", F.coalesce("removed", F.array().cast(gone.schema["removed"].dataType))).drop("__doc", "__digest", "__copy", "__hit", "__left")
