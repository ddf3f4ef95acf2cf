"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows.

1. Tokenize each document once, where it is read, and keep the ids (compressed) in the
   shared folder, with the place of each document in its source's queue: tasks number the
   tokens of each source, and prefix sums over tasks make the numbers global.
2. ``Schedule``: a source earns its share of every token that is packed, and the source
   that is owed most gives the next token. How many tokens of each source stand before any
   position has a closed form, so each window's quotas, and the deficits that it leaves to
   the next window or partition, are known without packing what comes before.
3. Parts of consecutive windows are dealt to tasks; a document goes to the parts that its
   tokens fall into. Each window takes its quotas from the queues.

Only the very last window can be short. It is cut into sequences whose lengths are
powers of two, so nothing is ever padded.
"""

from __future__ import annotations

import base64
import json
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, small_batches

WINDOW = 1024
#: Entries of a worker's word cache; it starts anew when full.
CACHE = 300_000
#: Windows of a part, which a task holds at a time: at most, and at least, so that there are parts for all tasks.
PART_MOST, PART_LEAST = 2048, 64


class WordCache(dict):
    """Token ids (little-endian uint16) of a word with its leading space; None for words that must not be cut out.

    ``path``: a byte-level BPE as a tokenizers .json, with the same vocabulary as a rank
    file (.tiktoken) beside it. Single words are encoded from the ranks, five times faster
    than by the tokenizer and to the same ids; what is not a word goes to the tokenizer.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]

    def encode(self, text: str) -> bytes:
        """Ids of any text without added tokens."""
        return np.asarray(self.ranks.encode_ordinary(text), "<u2").tobytes()

    def encode_whole(self, text: str) -> bytes:
        """Ids of any text, by the tokenizer itself."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= CACHE:
            self.clear()
        ids = None if not word or word[0].isspace() else self.encode(" " + word)
        if len(word) < 40:
            self[word] = ids
        return ids


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """The cache of this worker, which lives as long as it does."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def encode_text(text: str, cache: WordCache) -> bytes:
    """Ids of a text. The pattern always starts a piece at a space before a non-space, so words are encoded apart and cached.

    A text with an added token, which is recognised before any splitting, goes to the tokenizer whole.
    """
    if any(t in text for t in cache.added):
        return cache.encode_whole(text)
    first, *rest = text.split(" ")
    parts = list(map(cache.__getitem__, rest))
    if None in parts:  # runs of white space: their pieces depend on what follows
        return cache.encode(text)
    return cache.encode(first) + b"".join(parts)


def _tokenize(path: str, end_id: int):
    """(task, at, doc_id, source, n, ids): ``at`` counts the tokens of the source in this task before the document."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        cache, squeeze, task = word_cache(path), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        done: dict[str | None, int] = {}
        for batch in batches:
            ids, at, n = [], [], []
            for source, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = encode_text(t or "", cache) + end
                ids.append(squeeze.compress(x))
                n.append(len(x) // 2)
                at.append(done.get(source, 0))
                done[source] = at[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), task, np.int64)), pa.array(at, pa.int64()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["task", "at", "doc_id", "source", "n", "ids"]
            )

    return run


def tail_cuts(length: int) -> list[int]:
    """Lengths, all powers of two and falling, that make up ``length``."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Schedule:
    """How many tokens of each source stand before a position.

    Token k of a source falls due at (k + 1/2) / share; tokens are packed in order of
    their due times (ties: sources in order). At any position the count of a source with a
    full queue is its share of the tokens packed, rounded; sources whose queue is empty
    leave their part to the others. Sources of share 0 follow when all others are empty.
    """

    def __init__(self, totals: list[int], shares: list[float]):
        self.totals, share = np.array(totals, np.int64), np.array(shares, float)
        self.total = int(self.totals.sum())
        last = share <= 0
        self.rate = np.where(last, self.totals / max(self.total, 1), share)
        self.base = np.where(last, max((self.totals[~last] / share[~last]).max(initial=0), 0.0), 0.0)
        ends = np.unique(np.concatenate((self.base, self.base + self.totals / self.rate)))
        self.ends, self.flown = ends, np.clip((ends[:, None] - self.base) * self.rate, 0, self.totals).sum(1)

    def _due(self, count: np.ndarray) -> np.ndarray:
        """When the token after ``count`` falls due."""
        return np.where(count < self.totals, self.base + (count + 0.5) / self.rate, np.inf)

    def before(self, positions: np.ndarray) -> np.ndarray:
        """An array (positions, sources) of tokens before each position."""
        positions = np.asarray(positions, np.int64)
        v = np.interp(positions, self.flown, self.ends)
        count = np.clip(np.floor((v[:, None] - self.base) * self.rate + 0.5), 0, self.totals).astype(np.int64)
        while True:  # from about the right time, token by token to the very position
            gap = positions - count.sum(1)
            due, ran = self._due(count), np.where(count > 0, self.base + (count - 0.5) / self.rate, -np.inf)
            wrong = (gap == 0) & (ran.max(1) > due.min(1))
            more, less = np.flatnonzero((gap > 0) | wrong), np.flatnonzero((gap < 0) | wrong)
            if not len(more) and not len(less):
                return count
            add, drop = due[more].argmin(1), ran.shape[1] - 1 - ran[less][:, ::-1].argmax(1)
            count[more, add] += 1
            count[less, drop] -= 1

    def part_of(self, source: np.ndarray, token: np.ndarray, length: int) -> np.ndarray:
        """The part of ``length`` positions that a token of a source falls into."""
        due = self.base[source] + (token + 0.5) / self.rate[source]
        part = np.clip(np.interp(due, self.ends, self.flown) // length, 0, max(self.total - 1, 0) // length).astype(np.int64)
        while True:
            edges, inverse = np.unique(np.concatenate((part, part + 1)), return_inverse=True)
            counts = self.before(np.minimum(edges * length, self.total))[inverse]
            n = len(part)
            low, high = counts[np.arange(n), source] > token, counts[np.arange(n, 2 * n), source] <= token
            if not (low | high).any():
                return part
            part = part - low + high


def _deal(plan: Schedule, places: dict, length: int):
    """Rows (place, doc_id, n, ids, at, base) to rows (part, place, at, doc_id, source, n, start, length, ids), one a part that the document falls into."""
    names = {k: s for s, k in places.items()}
    fields = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            source = np.array([places[s] for s in batch.column(1).to_pylist()], np.int64)
            n, at, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4, 5))
            at = at + base
            if not len(n):
                continue
            first, last = plan.part_of(source, at, length), plan.part_of(source, at + n - 1, length)
            out = []
            for k, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                j, a, size, name = int(source[k]), int(at[k]), int(n[k]), names[int(source[k])]
                if first[k] == last[k]:
                    out.append((int(first[k]), j, a, doc, name, size, 0, size, ids))
                    continue
                data = open_.decompress(ids)
                parts = np.arange(first[k], last[k] + 1)
                cuts = np.clip(plan.before(np.minimum(np.append(parts, last[k] + 1) * length, plan.total))[:, j] - a, 0, size).tolist()
                out += [(int(p), j, a + lo, doc, name, size, lo, hi - lo, squeeze.compress(data[2 * lo : 2 * hi])) for p, lo, hi in zip(parts.tolist(), cuts, cuts[1:]) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(fields)], ["part", "place", "at", "doc_id", "source", "n", "start", "length", "ids"])

    return run


def _pack(plan: Schedule, window: int, length: int):
    whole = plan.total // window
    tail = np.cumsum([0, *tail_cuts(plan.total - whole * window)])

    def pieces(part: int, rows: list):
        """Pieces of one part; rows: (place, at, doc_id, source, n, start, length, ids) in order of place and at."""
        begin, end = part * length, min((part + 1) * length, plan.total)
        edges = np.append(np.arange(begin, end, window), end)
        count = plan.before(edges)
        took = np.diff(count, axis=0)
        ahead = np.cumsum(took, axis=1) - took  # tokens of the sources before this one in the window
        open_ = zstandard.ZstdDecompressor()
        for j, own in groupby(rows, key=lambda r: r[0]):
            own = list(own)
            at = np.array([r[1] for r in own], np.int64)
            cut = np.unique(np.concatenate((at, count[:, j])))
            cut = cut[(cut >= at[0]) & (cut < at[-1] + own[-1][6])]
            size = np.diff(np.append(cut, at[-1] + own[-1][6]))
            row, w = np.searchsorted(at, cut, "right") - 1, np.searchsorted(count[:, j], cut, "right") - 1
            offset = ahead[w, j] + cut - count[w, j]
            data = memoryview(np.frombuffer(b"".join(open_.decompress(r[7]) for r in own), "<u2").astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * lo : 4 * hi]) for lo, hi in zip((cut - at[0]).tolist(), (cut - at[0] + size).tolist(), strict=True)]
            start = np.array([r[5] for r in own])[row] + cut - at[row]
            out = [np.array([r[2] if r[2] is not None else 0 for r in own])[row], start, size, np.array(crc, np.int64), np.array([r[4] for r in own])[row], begin // window + w, offset]
            short = np.flatnonzero(out[5] == whole)
            if len(short):  # the last window: cut again at its powers of two
                out = [np.delete(x, short) for x in out] if len(short) < len(cut) else [x[:0] for x in out]
                for k in short.tolist():
                    lo, hi = int(offset[k]), int(offset[k] + size[k])
                    for c in np.unique(np.concatenate(([lo], tail[(tail > lo) & (tail < hi)]))).tolist():
                        s = int(np.searchsorted(tail, c, "right")) - 1
                        stop = min(hi, int(tail[s + 1]))
                        a = int(cut[k] - at[0]) + c - lo
                        new = (own[row[k]][2] or 0, int(start[k]) + c - lo, stop - c, zlib.crc32(data[4 * a : 4 * (a + stop - c)]), own[row[k]][4], whole + s, c - int(tail[s]))
                        out = [np.append(x, v) for x, v in zip(out, new, strict=True)]
                        row = np.append(row, row[k])
                row = np.delete(row, short)
            null = np.array([r[2] is None for r in own])[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0].astype(np.int64), mask=null), pa.array([own[0][3]] * len(row), pa.string()), *[pa.array(x.astype(np.int64)) for x in out[1:]]],
                ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    yield from pieces(part, rows) if rows else ()
                    part, rows = p, []
                rows.append(row)
        yield from pieces(part, rows) if rows else ()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, end_id: int = 0, targets: dict | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Returns one row a piece: doc_id, source, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. ``targets`` maps sources to shares; by default each source's
    share of all tokens, the only one that lets every window hold it to the end. Each
    window holds its target proportions to about a token; a source whose queue is empty
    leaves its turn to the others. The counts of the sources, one row a source, come to
    the driver. Null or empty texts are their end id alone; null sources form a queue of
    their own; rows that repeat are packed each time; an empty table gives no piece. A
    long text is cut over parts, so only its ids stand in one task. Ids are whole numbers,
    or strings of digits. Further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    ids = keep(thin.mapInArrow(_tokenize(tokenizer, end_id), "task long, at long, doc_id long, source string, n long, ids binary"), "ids")
    per_task = ids.groupBy("task", "source").agg(F.sum("n").alias("n"))
    totals = sorted(((r["source"], r["n"]) for r in per_task.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    total = sum(n for _, n in totals)
    mass = float(sum(targets.values())) if targets else 1.0
    plan = Schedule([n for _, n in totals], [targets.get(s, 0.0) / mass if targets else n / total for s, n in totals])
    places = {s: k for k, (s, _) in enumerate(totals)}

    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    windows = -(-total // window)
    length = window * max(PART_LEAST, min(PART_MOST, -(-windows // (4 * lanes))))
    parts = max(1, -(-total // length))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select(F.col("task").alias("t"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = ids.join(base, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "n", "ids", "at", "base")
    dealt = placed.mapInArrow(_deal(plan, places, length), "part long, place int, at long, doc_id long, source string, n long, start long, length long, ids binary")
    laid = dealt.repartition(min(parts, max(lanes, parts // 8)), "part").sortWithinPartitions("part", "place", "at")
    return laid.mapInArrow(_pack(plan, window, length), "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
