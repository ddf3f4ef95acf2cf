import numpy as np
import pytest

from millrace.llm import components as P
from millrace.llm import jaccard_join as J
from millrace.llm import line_dedup as L
from millrace.llm import textkit as X
from millrace.llm import verify as V


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def classes(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def word_sets(texts):
    import re

    out = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", t or "")
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)]
    got = {r["id"]: r["component"] for r in P.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = classes(5100, edges)
    assert all(want[x] == c for x, c in got.items()) and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_join_is_brute_force(spark, docs, corpus):
    rows = {r["doc_id"]: r for r in J.jaccard_join(docs).collect()}
    assert len(rows) == len(corpus)
    import re

    sets = word_sets(corpus)
    seqs = [tuple(re.findall(r"[^ \t-\r]+", t or "")) for t in corpus]
    n = len(corpus)
    pairs = [(a, b) for a in range(n) for b in range(a) if seqs[a] and (seqs[a] == seqs[b] or jaccard(sets[a], sets[b]) >= 0.8)]
    links = [0] * n
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert [rows[k]["n_links"] for k in range(n)] == links and max(links) > 8
    assert [rows[k]["class_id"] for k in range(n)] == classes(n, pairs)
    assert sum(r["is_first"] for r in rows.values()) == len(set(classes(n, pairs)))
    kept = J.first_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes(n, pairs))) and kept.columns == docs.columns


def test_join_odd(spark, odd, empty):
    got = J.jaccard_join(odd).collect()
    assert len(got) == odd.count()
    assert {(r["n_copies"], r["n_links"]) for r in got if r["doc_id"] == 1} == {(1, 1), (0, 0)}
    assert J.first_of_each(odd).count() == odd.count() - 1  # the repeated row goes, texts without words stay
    assert J.jaccard_join(empty).count() == 0 and J.first_of_each(empty).count() == 0


def test_blocks(spark):
    """A group over many blocks: all pairs counted once."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base + [f"x{k}"]) for k in range(700)] + [" ".join(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = J.jaccard_join(df).collect()
    assert {r["n_links"] for r in got} == {700} and {r["class_id"] for r in got} == {0}


def test_prefix_shortens():
    assert J.prefix_length(0.8, 24, 8, 0.999) == 6 and J.prefix_length(0.8, 24, 8, 0.995) == 7 and J.prefix_length(0.8, 24, 8, 0.5) == 8 and J.prefix_length(0.8, 4, 8, 0.999) == 1


def test_minhash_estimates():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate((a[:900], rng.integers(0, 1 << 62, 100).astype(np.uint64)))
    row = np.repeat([0, 1], 1000)
    for sig in (X.minhash(np.concatenate((a, b)), row, 2, 512), X.one_permutation(np.concatenate((a, b)), row, 2, 512)):
        assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.07


def test_hash_is_of_the_text():
    for s in ("", "a", "héllo wörld"):
        b = np.frombuffer(("x" + s + "yz").encode(), np.uint8)
        assert int(X.span_hashes(b, np.array([1]), np.array([len(b) - 2]))[0]) == X.text_hash(s)


def lines_of(texts):
    return [(d, k, x) for d, t in enumerate(texts) if t for k, x in enumerate(t.split("\n")) if x.strip(L.BLANK)]


def shingles(x, k=L.SHINGLE):
    return {x[i : i + k] for i in range(max(1, len(x) - k + 1))}


def test_lines_are_brute_force(spark, docs, corpus):
    got = {r["doc_id"]: r for r in L.line_dedup(docs).collect()}
    rows = lines_of(corpus)
    sets = [shingles(x) for _, _, x in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] == rows[b][2] or min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8]
    root = classes(len(rows), pairs)
    gone = {(d, k) for i, (d, k, _) in enumerate(rows) if root[i] != i}
    for d, t in enumerate(corpus):
        r = got[d]
        want = t and "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        assert r["text"] == want
        assert r["n_lines"] == sum(x[0] == d for x in rows) and r["n_lines"] - r["n_kept"] == sum(x[0] == d for x in gone) == len(r["removed"])
        for x in r["removed"]:
            first = root[next(i for i, y in enumerate(rows) if y[:2] == (d, x["line"]))]
            assert rows[first][:2] == (x["kept_doc"], x["kept_line"])
    assert len(gone) > 10


def test_lines_odd(spark, odd, empty):
    got = L.line_dedup(odd).orderBy("doc_id").collect()
    assert len(got) == 7 and sorted(str(r["text"]) for r in got if r["doc_id"] == 1) == ["", "another text of the same id", "one two three four five six"]
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None, None] and [r["text"] for r in got if r["doc_id"] is None] == ["null id"]
    assert L.line_dedup(empty).count() == 0


def test_short_near_lines(spark):
    """Short lines that differ in one character, number or word are near copies; lines that share less are not."""
    pairs = [
        ("Copyright 2019 by the authors of this small example work", "Copyright 2018 by the authors of this small example work"),
        ("Sign up for our weekly letter and never miss another story!", "Sign up for our weekly letter and never miss another story."),
        ("Posted in general notes by the editor on page 17 of the third and last volume of the year", "Posted in general notes by the editor on page 23 of the third and last volume of the year"),
        ("All opinions expressed in the comments below are those of their authors and do not reflect the views of the garden club", "All opinions expressed in the comments below are those of their authors and do not reflect the views of the sewing club"),
    ]
    apart = [("The first of these two lines is about cats and their long sleep", "The other of these lines has dogs that bark at night in the yard")]
    df = spark.createDataFrame([(k, "\n".join(p[k] for p in pairs + apart)) for k in range(2)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.line_dedup(df).collect()}
    assert got[0]["removed"] == [] and got[0]["n_kept"] == 5
    assert [(x["line"], x["kept_doc"], x["kept_line"]) for x in got[1]["removed"]] == [(k, 0, k) for k in range(len(pairs))]
    assert got[1]["text"] == apart[0][1]


def test_line_recall():
    """Banding finds nearly all pairs at the threshold and above."""
    import random

    rng = random.Random(3)
    found = total = 0
    for _ in range(150):
        a = [chr(rng.randrange(97, 123)) for _ in range(rng.choice((60, 200, 400)))]
        b = list(a)
        for _ in range(max(1, len(a) // 100)):
            b[rng.randrange(len(b))] = "#"
        if jaccard(shingles("".join(a)), shingles("".join(b))) < 0.8:
            continue
        codes = np.array([ord(c) for c in a + b], np.uint32)
        h, row = X.char_shingles(codes, np.array([0, len(a)]), np.array([len(a), len(codes)]), L.SHINGLE)
        k = X.band_keys(X.one_permutation(h, row, 2, L.BANDS * L.ROWS), L.BANDS, L.ROWS)
        total, found = total + 1, found + bool((k[0] == k[1]).any())
    assert total > 60 and found >= 0.97 * total


def test_bands_move_packed():
    """The keys of many lines move as a few rows, none lost: before, each line made a row a band."""
    import pyarrow as pa

    texts = ["\n".join(f"line {k} of text {t} with some words" for k in range(40)) for t in range(100)]
    made = list(L._bands(L.SHINGLE, L.BANDS, L.ROWS)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    pairs = [np.frombuffer(v.as_buffer(), np.int64).reshape(-1, 2) for b in made for v in b.column(1)]
    assert sum(b.num_rows for b in made) <= 1 << V.PARTS < 4000 * L.BANDS == sum(len(p) for p in pairs)
    assert {int(i) for p in pairs for i in p[:, 1]} == {L.line_key(x)[0] for t in texts for x in t.split("\n")}
    for b in made:
        for part, p in zip(b.column(0).to_pylist(), b.column(1)):
            assert (np.frombuffer(p.as_buffer(), np.int64)[::2] & (1 << V.PARTS) - 1 == part).all()


@pytest.mark.parametrize("many", [60, 10_000])
def test_buckets_are_brute_force(monkeypatch, many):
    """Ranges read at once and piece by piece, with large buckets, repeated rows and keys of one row."""
    import pyarrow as pa

    for name, v in (("READ", 50), ("MANY", many), ("PARTS", 3), ("PACK", 37)):
        monkeypatch.setattr(V, name, v)
    rng, block = np.random.default_rng(4), 8
    keys = rng.integers(-(1 << 62), 1 << 62, 400)
    rows = [(k, i) for k in keys[:200] for i in rng.integers(0, 1000, rng.integers(1, 6))] + [(k, i) for k in keys[200:205] for i in rng.integers(0, 200, 300)] + [(k, 1) for k in keys[205:]]
    rows = [rows[k] for k in rng.permutation(len(rows))] * 2
    k, i = np.array(rows).T
    laid = pa.Table.from_batches(V.packed((k[a : a + 90], i[a : a + 90]) for a in range(0, len(k), 90))).sort_by("part")
    got = [tuple(r.values()) for b in V._unpacked(block)(laid.to_batches(max_chunksize=10)) for r in b.to_pylist()]
    ids = {}
    for a, b in rows:
        ids.setdefault(a, set()).add(b)
    by, large, blocks = {}, {}, {}
    for bucket, big, at, x in got:
        (large if big else by).setdefault(bucket, []).append(x)
        blocks.setdefault((bucket, at), set()).add(x)
    assert sorted(map(sorted, by.values())) == sorted(sorted(s) for s in ids.values() if 1 < len(s) <= block)
    assert sorted(sorted(set(v)) for v in large.values()) == sorted(sorted(s) for s in ids.values() if len(s) > block)
    assert len(large) == 5 and max(map(len, blocks.values())) <= block


def test_small_links_are_brute_force():
    """Blocks of 1 to SMALL rows, some empty or equal: every pair counted on whole sets."""
    rng = np.random.default_rng(6)
    n = rng.integers(1, V.SMALL + 1, 40)
    sets = []
    for m in n.tolist():
        base = rng.integers(0, 1 << 62, 12)
        sets += [[] if rng.random() < 0.1 else [*base[: rng.integers(8, 13)], *rng.integers(0, 1 << 62, rng.integers(0, 3)), base[0]] for _ in range(m)]
    h, row = np.array([x for s in sets for x in s], np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    first = np.cumsum(n) - n
    got = {(int(a), int(b)): s for a, b, s in zip(*V.small_links(h, row, first, n, 0.7), strict=True)}
    pairs = {(a, b): jaccard(set(sets[a]), set(sets[b])) for f, m in zip(first.tolist(), n.tolist()) for b in range(f, f + m) for a in range(f, b)}
    want = {p: j for p, j in pairs.items() if j >= 0.7 - 1e-9}
    assert got == pytest.approx(want) and len(want) > 40
    assert all(len(x) == 0 for x in V.small_links(h[:0], row[:0], np.array([0]), np.array([2]), 0.7))


@pytest.mark.parametrize("size", [1, 5])
def test_shingles_are_the_polynomial(size):
    """Places of every span, short and empty-sided ones too, have the hash of their characters alone."""
    text = "abcdefg" + "hi" + "jklmn" + "o" + "pqrstuvwxyz"
    starts, ends = np.array([0, 7, 9, 14, 15]), np.array([7, 9, 14, 15, 26])
    h, span = X.char_shingles(np.array([ord(c) for c in text], np.uint32), starts, ends, size)
    alone = [X.char_shingles(np.array([ord(c) for c in text[a:b]], np.uint32), np.array([0]), np.array([b - a]), size)[0] for a, b in zip(starts, ends)]
    assert h.tolist() == np.concatenate(alone).tolist() and span.tolist() == np.repeat(np.arange(5), [len(a) for a in alone]).tolist()
    assert [len(X.char_shingles(np.zeros(n, np.uint32), np.array([0]), np.array([n]), size)[0]) for n in range(1, 8)] == [max(1, n - size + 1) for n in range(1, 8)]
    x = 0
    for c in reversed(text[:size]):
        x = (x * X.BASE + ord(c) + 1) % (1 << 64)
    x ^= x >> 32
    x = x * 0xBF58476D1CE4E5B9 % (1 << 64)
    assert int(h[0]) == x ^ x >> 29


def test_copies_of_blank_texts(spark):
    """Rows of equal id and text are copies even when no line of them is visible."""
    df = spark.createDataFrame([(1, " \n "), (1, " \n "), (1, "\n"), (2, " \n ")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_lines"]) for r in L.line_dedup(df).collect())
    assert got == [(1, "", 0), (1, "\n", 0), (1, " \n ", 0), (2, " \n ", 0)]
