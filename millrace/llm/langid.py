"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each of its slots is a bit mask with one bit a
language (the filters of all languages, sliced by bit; 64 languages a word of the mask).
Every n-gram of the training documents of a language sets its bit. The AND of an n-gram's
slots is the set of languages that contain it, read with as many lookups as there are hash
functions, however many languages there are. For a text, the bits are counted per
language, the hits that the filter's false positives explain are taken off, and the
largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, small_batches, without
from .textkit import BASE, U, chunks, mix, powers

#: Lengths of character n-grams; words are padded with one space on either side.
SIZES = (2, 3, 4)
HASHES = 2
#: Slots of the filter, as a power of two.
BITS = 21


@dataclass
class LanguageFilter:
    """slots: a row of mask words a slot; languages: names by bit; false_rate: share of foreign n-grams that each language's bits let pass; default: the language of most training documents."""

    slots: np.ndarray
    languages: list[str]
    false_rate: np.ndarray
    default: str | None


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space (32) where it is no letter."""
    if not _letters:
        table = np.full(0x110000, 32, np.int32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a chunk, their rows, and the letters of each row."""
    rows = len(off) - 1
    lead = (b & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[off]
    codes = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = letter_table()[np.minimum(codes, 0x10FFFF)]
    row = np.repeat(np.arange(rows), np.diff(at))
    # a space before each row, and runs of spaces as one
    spaced = np.insert(low, at[:-1], 32)
    row = np.insert(row, at[:-1], np.arange(rows))
    space = spaced == 32
    stay = np.ones(len(spaced), bool)
    stay[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    spaced, row = np.append(spaced[stay], 32), np.append(row[stay], rows)
    letters = np.bincount(row[spaced != 32], minlength=rows + 1)[:rows]
    n = len(spaced)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((spaced.astype(U) + U(1)) * up[:n], out=total[1:])
    inner = spaced == 32
    out, owner = [], []
    for size in SIZES:
        if n < size:
            continue
        m = n - size + 1
        ok = np.ones(m, bool)
        for k in range(1, size - 1):  # a gram may begin or end with a space, not hold one
            ok &= ~inner[k : k + m]
        last = row[size - 1 : size - 1 + m]
        ok &= (last == row[:m]) | (inner[size - 1 : size - 1 + m] & (row[size - 2 : size - 2 + m] == row[:m]))
        ok &= ~(inner[:m] & inner[size - 1 : size - 1 + m]) if size == 2 else True
        i = np.flatnonzero(ok)
        out.append(mix((total[i + size] - total[i]) * down[i] + U(size) * U(BASE)))
        owner.append(row[i])
    h, owner = (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, U), np.zeros(0, np.int64))
    return h, owner, letters


def slots_of(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> U(bits * k) & U((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


def _spots(bits: int):
    """(slot, word, mask) from rows (bit number of the language, text): what the n-grams of each language set, once a chunk."""

    def run(batches):
        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, b, off in chunks(batch.column(1)):
                h, row, _ = grams(b, off)
                mine, k = np.unique(lang[i:j], return_inverse=True)
                spots = np.unique(np.concatenate([s * len(mine) + k[row] for s in slots_of(h, bits)]))
                slot, bit = spots // len(mine), mine[spots % len(mine)]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((bit // 64).astype(np.int32)), pa.array((U(1) << (bit % 64).astype(U)).view(np.int64))], ["slot", "word", "mask"])

    return run


#: Parts of a language in which the least hashes are found first.
PARTS = 64


def picked(texts: DataFrame, per_language: int) -> DataFrame:
    """(lang, h) of the ``per_language`` different texts of each language that hash lowest.

    The least of each of ``PARTS`` parts of a language are found first, so no task ranks
    all rows of one.
    """
    part = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h")
    some = texts.select("lang", "h").distinct().withColumn("k", F.row_number().over(part)).filter(F.col("k") <= per_language).drop("k")
    return some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= per_language).drop("k")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, bits: int = BITS) -> LanguageFilter:
    """Fit the filter on at most ``per_language`` labelled documents of each language, picked by a hash of their text.

    All n-grams of the picked documents are inserted. Languages are as many as the labels
    name; the filter has ``2**bits`` slots of one bit a language. Rows with a null text or
    language teach nothing.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    texts = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text", F.lit(7)))
    chosen = keep(picked(texts, per_language), "picked")
    names = [(r["lang"], r["count"]) for r in chosen.groupBy("lang").count().orderBy("lang").collect()]  # one row a language
    languages = [n for n, _ in names]
    words = max(1, -(-len(names) // 64))
    slots = np.zeros((1 << bits, words), U)
    if names:
        bit = spark.createDataFrame(list(zip(languages, range(len(names)))), "lang string, bit long")
        # copies of a picked text collapse before they move
        some = texts.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).join(bit, "lang")
        spots = some.select("bit", "text").mapInArrow(_spots(bits), "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
        spots = spots.toPandas()  # the filter: at most one row a slot and mask word, whatever the corpus
        slots[spots["slot"].to_numpy(np.int64), spots["word"].to_numpy(np.int64)] = spots["mask"].to_numpy(np.int64).view(U)
    filled = np.array([(slots[:, k // 64] >> U(k % 64) & U(1)).mean() for k in range(len(names))])
    if len(names) <= 8:
        slots = slots.astype(np.uint8)  # one byte a slot will do
    return LanguageFilter(slots, languages, filled**HASHES, min(names, key=lambda x: (-x[1], x[0]))[0] if names else None)


def classify(b: np.ndarray, off: np.ndarray, model: LanguageFilter) -> tuple[list, np.ndarray]:
    """Languages and scores of a chunk's rows."""
    rows, bits = len(off) - 1, int(len(model.slots)).bit_length() - 1
    h, row, letters = grams(b, off)
    n = np.bincount(row, minlength=rows)[:rows].astype(float)
    net = np.zeros((rows, len(model.languages)))
    for word in range(model.slots.shape[1]):
        mask = None
        for s in slots_of(h, bits):
            found = model.slots[s, word]
            mask = found if mask is None else mask & found
        for k in range(64 * word, min(64 * word + 64, len(model.languages))):
            bit = mask.dtype.type(1 << k % 64)
            net[:, k] = np.bincount(row[(mask & bit) != 0], minlength=rows)[:rows]
    # a foreign n-gram passes at the filter's false rate; where every slot is taken nothing can be told apart
    net = np.maximum(0, (net - n[:, None] * model.false_rate) / np.maximum(1 - model.false_rate, 1e-9))
    lang, score = [], np.zeros(rows)
    for k in range(rows):
        if not letters[k] or not model.languages:
            lang.append("und")
            continue
        top = float(net[k].max())
        best = int(np.argmax(net[k]))
        if not top or (model.default and net[k][model.languages.index(model.default)] == top):
            best = model.languages.index(model.default)
        lang.append(model.languages[best])
        score[k] = min(1.0, top / max(n[k], 1))
    return lang, score


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, the share of n-grams that the language contains, corrected).

    ``und`` and 0 if the text is null or has no letter, or if the filter knows no language
    at all. Ties, and a text of which no n-gram is known (score 0), go to the language with
    most training documents if it is among them, else to the first by name. Rows are judged
    one by one, so repeated rows agree; a long text takes some 60 times its bytes of memory.
    Columns of these names in ``docs`` are replaced; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for 8 languages, 16 MB for each 64: a byte or a word a slot

    @F.pandas_udf("lang string, score double")
    def label(texts):
        import pandas as pd

        langs, scores = [], [np.zeros(0)]
        for _, _, b, off in chunks(pa.array(texts, pa.string(), from_pandas=True)):
            lang, score = classify(b, off, held.value)
            langs += lang
            scores.append(score)
        return pd.DataFrame({"lang": langs, "score": np.concatenate(scores)})

    label = label.asNondeterministic()  # so that the planner runs it once a row
    out = without(docs, "lang_pred", "score").withColumn("__label", label(F.col(text_col).cast("string")))
    return out.withColumn("lang_pred", F.col("__label.lang")).withColumn("score", F.col("__label.score")).drop("__label")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """Train on the labelled rows that are not held out, and label every row: adds held_out, lang_pred and score."""
    docs = without(docs, "held_out", "lang_pred", "score")
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col, **training)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, text_col)
