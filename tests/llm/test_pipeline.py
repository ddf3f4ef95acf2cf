"""The pipeline against a plain Python version of its five stages, and each stage on odd tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import langid as G
from millrace.llm import line_dedup as L

from .test_dedup import classes, jaccard, lines_of, shingles, word_sets
from .test_text_ops import targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_language(rows, model):
    """Rows of a known language, each judged alone."""
    out = []
    for r in rows:
        b = np.frombuffer((r["text"] or "").encode(), np.uint8)
        (lang,), (score,) = G.classify(b, np.array([0, len(b)]), model)
        if lang != "und" and score >= P.LEAST_SCORE:
            out.append(r)
    return out


def plain_lines(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    found = lines_of([r["text"] for r in rows])
    sets = [shingles(x) for _, _, x in found]
    near = lambda a, b: found[a][2] == found[b][2] or min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8
    root = classes(len(found), [(a, b) for a in range(len(found)) for b in range(a) if near(a, b)])
    gone = {found[k][:2] for k in range(len(found)) if root[k] != k}
    out = []
    for d, r in enumerate(rows):
        mine = [k for x, k, _ in found if x == d]
        left = r["text"] and "\n".join(x for k, x in enumerate(r["text"].split("\n")) if (d, k) not in gone)
        if not mine or any((d, k) not in gone for k in mine) and len(left) >= P.LEAST_LEFT * len(r["text"]):
            out.append(r | {"text": left, "n_chars": None if left is None else len(left)})
    return out


def plain_documents(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets, words = word_sets([r["text"] for r in rows]), [WORD.findall(r["text"] or "") for r in rows]
    n = len(rows)
    root = classes(n, [(a, b) for a in range(n) for b in range(a) if words[a] and (words[a] == words[b] or jaccard(sets[a], sets[b]) >= 0.8)])
    return [r for k, r in enumerate(rows) if root[k] == k]


def plain_mix(rows):
    """Rows as often as they are taken: the draw is an MD5 of the id, the threshold the point at which a source's draws come nearest."""
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    u = {r["doc_id"]: int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48 for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    goal = targets({s: sum(size[r["doc_id"]] for r in mine) for s, mine in by.items()})
    out = []
    for s, mine in by.items():
        total = sum(size[r["doc_id"]] for r in mine)
        rate = goal[s] / total if total else 0.0
        whole = math.floor(rate + 1e-9)
        need = max(0.0, rate - whole) * total
        cells = sorted({int(u[r["doc_id"]] * 4096) for r in mine})
        below = {c: sum(size[r["doc_id"]] for r in mine if int(u[r["doc_id"]] * 4096) <= c) for c in cells}
        miss, edge = min((abs(below[c] - need), c + 1) for c in cells)
        threshold = 0 if need <= miss else edge / 4096
        for r in mine:
            out += [r] * (whole + (u[r["doc_id"]] < threshold))
    return out


def keys(rows):
    return sorted((r["doc_id"], r["text"] or "", str(r["source"]), r["n_chars"] if r["n_chars"] is not None else -1) for r in rows)


def test_run_is_the_plain_version(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = G.train(docs.filter(~G.held_out()))
    now, df, sizes = rows, docs, []
    for (name, stage), plain in zip(P.STAGES[:-1], (lambda x: plain_language(x, model), plain_lines, plain_documents, plain_mix), strict=True):
        now, df = plain(now), stage(spark, df, str(tmp_path)).cache()
        assert df.columns == docs.columns and keys(r.asDict() for r in df.collect()) == keys(now), name
        sizes.append(len(now))
    assert len(rows) > sizes[0] > sizes[1] >= sizes[2] > 30
    tokenizer = Tokenizer.from_file(P.tokenizer_path())
    want = {}
    for r in now:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    out = P.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.filter("n > 1024").isEmpty() and full.filter("n < 1024").count() <= 10


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, odd, empty, k):
    """Null ids, texts, languages and sources; repeated rows; clashing columns; no rows at all; a text above 1 MB."""
    stage = P.STAGES[k][1]
    out = stage(spark, odd, "")
    assert stage(spark, empty, "").count() == 0
    rows = out.collect()
    if k < 4:
        assert out.columns == P.COLUMNS
    if k == 0:  # text and language are known of some rows only: those without letters go
        assert {r["text"] for r in rows} >= {"one two three four five six"} and all(r["text"] for r in rows)
    if k == 1:  # the first of the repeated rows stays, and the rows without lines
        assert sorted(str(r["text"]) for r in rows) == sorted(["null id", "one two three four five six", "another text of the same id", "None", "None", ""])
    if k == 2:
        assert len(rows) == odd.count() - 1
    if k == 4:
        assert sum(r["start"] == 0 for r in rows) == odd.count()
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000)]
    long = "\n".join(" ".join(words[i] for i in rng.integers(0, 3000, 12)) for _ in range(14_000))
    df = spark.createDataFrame([(1, long, "en", "s", len(long)), (5, "a short text of few words", "en", "s", 25)], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, df, "").collect()
    assert len(long) > 1 << 20 and {r["doc_id"] for r in got} == {1, 5}
    if k < 4:
        assert next(r["text"] for r in got if r["doc_id"] == 1) == long
    else:
        assert sum(r["length"] for r in got if r["doc_id"] == 1) == next(r["doc_tokens"] for r in got if r["doc_id"] == 1)


def test_copies_go_whole(spark):
    """A near copy with a few edited lines goes; a document that quotes one shared line stays."""
    rng = np.random.default_rng(3)
    line = lambda: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(12))
    first = [line() for _ in range(10)]
    copy = [*first[:4], line(), *first[5:]]
    quote = [line() for _ in range(5)] + [first[0]]
    df = spark.createDataFrame([(k, "\n".join(x), "en", "s", 0) for k, x in enumerate((first, copy, quote))], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in P.unique_lines(spark, df, "").collect()}
    assert got == {0: "\n".join(first), 2: "\n".join(quote[:5])}


def test_no_language_to_learn(spark, docs):
    assert P.known_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == docs.count()


def test_blank_is_the_same_everywhere():
    assert all(c.isspace() or c == "\x85" for c in L.BLANK)
