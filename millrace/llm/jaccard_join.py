"""Self-join on the Jaccard similarity of word n-grams: a MinHash LSH forest, then exact verification.

1. Every different text has a label in each of ``trees`` tries: ``depth`` MinHashes of its
   set, one after the other. The labels of a trie are sorted, so the texts below a node,
   those that share a prefix, stand together.
2. All nodes of the greatest depth are searched first: the texts of a node are a bucket of
   candidates, verified exactly (see ``verify``). From the similarities of the links found,
   the recall of this prefix length is estimated: a pair of similarity s shares a node of
   depth d in one of t tries with probability 1 - (1 - s**d)**t. As long as it is below
   the target the prefixes are shortened by one, and the nodes that grew are searched. At
   ``prefix_length`` the target holds even if every link were just at the threshold.
3. Union-find over verified links gives the classes; inside a class all pairs are compared
   to count the links of each text.

A text is known by 128 bits of its words; labels carry the first 64 of them, which may
only add candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import may_contain
from .components import components, split_join
from .store import keep, small_batches, without
from .textkit import BASE, SPACED, U, chunks, minhash, mix, signed, span_hashes, word_shingles, words
from .verify import BLOCK, Buckets, counted, gathered, linked

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 24, 8, 0.995


def chance(similarity, prefix: int, trees: int):
    """Probability that a pair of this similarity shares a prefix in one of the tries."""
    return 1 - (1 - similarity**prefix) ** trees


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix with which a pair at the threshold is found with the target probability."""
    d = depth
    while d > 1 and chance(threshold, d, trees) < target:
        d -= 1
    return d


def _shingles(b, off, size):
    starts, ends, first = words(b, off, SPACED)
    h = span_hashes(b, starts, ends)
    return *word_shingles(h, first, size), np.diff(first)


def _identities(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of the words of each row, and their number."""
    one, two, n = [], [], []
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        w = b[lo:hi].tobytes().split()  # splits at ASCII white space
        d = xxhash.xxh3_128_intdigest(b" ".join(w))
        one.append(d >> 64)
        two.append(d & (1 << 64) - 1)
        n.append(len(w))
    return signed(np.array(one, U)), signed(np.array(two, U)), np.array(n, np.int64)


def _rows(batches):
    """(h1, h2, doc, digest, words) of each text."""
    for batch in batches:
        for i, j, b, off in chunks(batch.column(2)):
            a, c, n = _identities(b, off)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n)], ["h1", "h2", "doc", "digest", "words"])


#: Texts that a task remembers to have labelled; it forgets them all when there are more.
SEEN = 100_000


def _labels(size: int, trees: int, depth: int):
    """(tree, label, id) of the different texts of the task; a label is ``depth`` MinHashes of 16 bits and sorts as they do."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, b, off in chunks(batch.column(0)):
                ids = _identities(b, off)[0]
                new = np.zeros(len(ids), bool)
                for k, x in enumerate(ids.tolist()):
                    new[k] = x not in seen
                    seen.add(x)
                sh, row, n = _shingles(b, off, size)
                new &= n > 0
                if len(seen) > SEEN:
                    seen.clear()
                if not new.any():
                    continue
                on = new[row]
                sig = minhash(sh[on], (np.cumsum(new) - 1)[row[on]], int(new.sum()), trees * depth)
                raw = np.ascontiguousarray((sig & 0xFFFF).astype(">u2")).tobytes()
                n = len(sig) * trees
                label = pa.Array.from_buffers(pa.binary(2 * depth), n, [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(sig))), label, pa.array(np.repeat(ids[new], trees))], ["tree", "label", "id"])

    return run


def _nodes(depth: int, least: int, block: int):
    """(level, bucket, big, block, id): the nodes of depth ``depth`` to ``least`` with several texts, from sorted rows (tree, label, id)."""

    def run(batches):
        readers = {d: Buckets(block) for d in range(depth, least - 1, -1)}

        def said(level, tables):
            for t in tables:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), level, np.int32)), *t.columns], ["level", "bucket", "big", "block", "id"])

        for table in gathered(batches):
            labels = np.frombuffer(b"".join(table.column(1).to_pylist()), ">u2").reshape(-1, depth)
            ids = table.column(2).to_numpy()
            key = table.column(0).to_numpy().astype(U) + U(1)
            for d in range(1, depth + 1):
                key = mix(key * U(BASE) + labels[:, d - 1].astype(U))
                if d >= least:
                    yield from said(d, readers[d].push(signed(key), ids))
        for d, reader in readers.items():
            yield from said(d, reader.close())

    return run


def shingles_of(size: int):
    """Texts -> (shingle hashes, the number of the text of each)."""

    def flat(texts):
        hashes, rows = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for i, _, b, off in chunks(pa.array(texts, pa.string())):
            h, row, _ = _shingles(b, off, size)
            hashes.append(h)
            rows.append(row + i)
        return np.concatenate(hashes), np.concatenate(rows)

    return flat


def forest(texts: DataFrame, size: int, trees: int, depth: int, least: int, block: int = BLOCK) -> DataFrame:
    """(level, bucket, big, block, id): nodes of the tries with several texts; those with the texts of a deeper node only as that."""
    labels = texts.mapInArrow(_labels(size, trees, depth), "tree int, label binary, id long")
    sorted_ = labels.repartition("tree", F.substring("label", 1, 2 * least)).sortWithinPartitions("tree", "label", "id")
    nodes = sorted_.mapInArrow(_nodes(depth, least, block), "level int, bucket long, big boolean, block int, id long")
    return nodes.groupBy("bucket", "big", "block", "id").agg(F.max("level").alias("level"))


def estimated_recall(edges: DataFrame, prefix: int, trees: int) -> float:
    """Share of links found with this prefix length, by the similarities of those found; 0 if there are none."""
    cells = edges.groupBy(F.round("similarity", 2).alias("s")).count().collect()  # at most 101 rows
    found = sum(c["count"] for c in cells)
    return found / sum(c["count"] / chance(c["s"], prefix, trees) for c in cells) if found else 0.0


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: the id, class_id, n_links, n_text_links, n_copies and is_first.

    Words stand between ASCII white space; a text's set is that of its runs of ``size``
    words (of all its words if it has fewer). Texts of the same words are copies. Two
    texts are linked if the similarity of their sets is ``threshold`` or more.
    n_text_links counts linked different texts, n_links the rows that these and the
    copies stand for, n_copies the other rows of the same words. class_id is the least
    id of the connected component, and is_first marks one row of each: that of the least
    id (repeated rows of it: each is marked, see ``first_of_each``). Texts without words
    (null, empty, white space) are copies of nothing: each is its own class. A null id
    stands below all others in classes. Ids are whole numbers, or strings of digits. A
    text of any length is worked on whole, in a chunk of its own; further columns are not
    read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))
    rows = keep(thin.mapInArrow(_rows, "h1 long, h2 long, doc long, digest long, words long"), "rows")
    texts = rows.filter("words > 0").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "digest")).alias("least"))
    texts = keep(texts, "texts")

    least = prefix_length(threshold, trees, depth, recall)
    nodes = keep(forest(thin.filter(F.length("text") > 0).select("text"), size, trees, depth, least), "nodes")
    where = keep(texts.join(nodes.select(F.col("id").alias("h1")).distinct(), "h1", "left_semi"), "where")
    holds = may_contain(where.select("least.doc").filter("doc is not null"), where.count(), "doc")
    found = thin.filter(holds(F.col("doc")) | F.col("doc").isNull()).select("text").mapInArrow(_keyed, "h1 long, h2 long, text string")
    found = found.join(where.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("text").alias("text"))
    store = keep(found.withColumn("id", F.monotonically_increasing_id()), "store")  # written: an id of 64 bits for each text of 128
    known = store.select("h1", "h2", F.col("id").alias("node"))
    edges = None
    for prefix in range(depth, least - 1, -1):
        members = nodes.filter(F.col("level") == prefix).join(known, F.col("id") == F.col("h1")).select("bucket", "big", "block", F.col("node").alias("id"))
        more = linked(members, store.select("id", "text"), shingles_of(size), threshold, name=f"links-{prefix}")
        edges = more if edges is None else edges.union(more)
        if estimated_recall(edges, prefix, trees) >= recall:
            break
    classes = keep(components(edges.select("a", "b"), "classes").join(known, F.col("id") == F.col("node")).join(where, ["h1", "h2"]).select("id", "component", F.col("n").alias("weight"), "h1", "h2", "least"), "classes")
    links = counted(classes.select("id", "component", "weight"), store.select("id", "text"), shingles_of(size), threshold)

    heads = classes.groupBy("component").agg(F.min(F.struct("least.doc", "least.digest", "h1", "h2")).alias("head"))
    near = split_join(classes, heads, ["component"], name="heads").join(links.withColumnRenamed("weight", "others"), "id", "left").select("h1", "h2", "links", "others", "head")
    named = texts.join(near, ["h1", "h2"], "left").filter("n > 1 or head is not null")
    named = named.select("h1", "h2", "n", "links", "others", F.coalesce("head", F.struct("least.doc", "least.digest", "h1", "h2")).alias("head"))
    # a text may stand in a third of all rows: they can be split over tasks
    out = split_join(rows, named, ["h1", "h2"], "left", "named")
    copies = F.coalesce(F.col("n") - 1, F.lit(0))
    mine = F.struct("doc", "digest", "h1", "h2")
    return out.select(
        F.col("doc").alias(id_col),
        F.when(F.col("head").isNotNull(), F.col("head.doc")).otherwise(F.col("doc")).alias("class_id"),
        (F.coalesce("others", F.lit(0)) + copies).cast("long").alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"),
        copies.cast("long").alias("n_copies"),
        (F.col("head").isNull() | mine.eqNullSafe(F.col("head"))).alias("is_first"),
        "digest",
    )


def _keyed(batches):
    for batch in batches:
        for i, j, b, off in chunks(batch.column(0)):
            h1, h2, _ = _identities(b, off)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).slice(i, j - i)], ["h1", "h2", "text"])


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, then the least hash of its text.

    Of rows equal in id and text one stays. Texts without words are kept.
    """
    found = jaccard_join(docs, id_col, text_col, **how)
    said = found.groupBy(F.col(id_col).alias("__id"), F.col("digest").alias("__digest")).agg(F.max("is_first").alias("__stay"), F.count("*").alias("__n"), F.max("n_copies").alias("__copies"))
    said = keep(said.filter("not __stay or (__n > 1 and __copies > 0)"), "said")
    holds = may_contain(said, said.count(), "__digest")
    docs = without(docs, "__hit", "__key", "__k")
    marked = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("__hit", holds(F.col("__key")))
    suspect = marked.filter("__hit").join(said, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__digest")), "left")
    suspect = suspect.withColumn("__k", F.row_number().over(Window.partitionBy(id_col, "__key").orderBy("__key")))
    suspect = suspect.filter("__stay is null or (__stay and __k = 1)")
    return marked.filter("not __hit").unionByName(suspect.select(*marked.columns)).drop("__hit", "__key")
