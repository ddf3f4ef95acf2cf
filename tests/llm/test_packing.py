import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import packing as P
from millrace.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(rows, texts, tokenizer, window=1024):
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for d, ps in pieces.items():
        at = 0
        for r in sorted(ps, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for ps in windows.values():
        at = 0
        for r in sorted(ps, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0  # full, or a power of two
    return windows


def test_pieces(spark, docs, corpus, tokenizer):
    check(P.pack(docs, tokenizer_path()).collect(), dict(enumerate(corpus)), tokenizer)


@pytest.mark.parametrize("windows", [3, 64])
def test_parts_and_mixture(spark, tables, tokenizer, monkeypatch, windows):
    """Windows over many parts hold every source at its target to about a token, each and in sum."""
    monkeypatch.setattr(P, "PART_LEAST", windows)
    monkeypatch.setattr(P, "PART_MOST", windows)
    rows = P.pack(tables.documents, tokenizer_path()).collect()
    packed = check(rows, {r["doc_id"]: r["text"] for r in tables.documents.collect()}, tokenizer)
    total, by = sum(r["length"] for r in rows), defaultdict(int)
    for r in rows:
        by[r["source"]] += r["length"]
    ran, full = defaultdict(int), total // 1024
    assert full > 2 * 64 and len(by) > 3
    for w in range(full):
        took = defaultdict(int)
        for r in packed[w]:
            took[r["source"]] += r["length"]
            ran[r["source"]] += r["length"]
        assert sum(took.values()) == 1024
        assert all(abs(took[s] - by[s] / total * 1024) <= 2 for s in by)
        assert all(abs(ran[s] - by[s] / total * 1024 * (w + 1)) <= 1 for s in by)


def brute_schedule(totals, shares):
    """Sources of all tokens in order: the one that is due first, then the sources of share 0."""
    tokens = [((k + 0.5) / s, j) for j, (n, s) in enumerate(zip(totals, shares)) if s > 0 for k in range(n)]
    rest = [((k + 0.5) / n, j) for j, (n, s) in enumerate(zip(totals, shares)) if s <= 0 for k in range(n)]
    return [j for _, j in sorted(tokens) + sorted(rest)]


@pytest.mark.parametrize("totals, shares", [([50, 30, 20], [0.5, 0.3, 0.2]), ([50, 30, 20], [0.2, 0.3, 0.5]), ([7, 7, 7, 90], [0.25] * 4), ([40, 60, 10, 5], [0.9, 0.1, 0.0, 0.0]), ([1, 500], [1 / 501, 500 / 501]), ([12], [1.0])])
def test_schedule_is_brute_force(totals, shares):
    plan, order = P.Schedule(totals, shares), brute_schedule(totals, shares)
    want = np.array([[order[:p].count(j) for j in range(len(totals))] for p in range(len(order) + 1)])
    assert (plan.before(np.arange(len(order) + 1)) == want).all()
    seen = [0] * len(totals)
    for p, j in enumerate(order):
        assert plan.part_of(np.array([j]), np.array([seen[j]]), 7)[0] == p // 7
        seen[j] += 1


def test_targets(spark, docs):
    """Sources with a target come first, in its proportions; the others follow."""
    rows = sorted(P.pack(docs, tokenizer_path(), targets={"a": 3.0, "b": 1.0}, window=64).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    first = [r["source"] for r in rows if r["sequence_id"] < 10 for _ in range(r["length"])]
    assert len(first) == 640 and first.count("a") == 480 and first.count("b") == 160
    assert {r["source"] for r in rows} == {"a", "b", "c", None}


def test_long_text(spark, tokenizer, monkeypatch):
    """A text above 1 MB is cut over parts."""
    monkeypatch.setattr(P, "PART_MOST", 16)
    monkeypatch.setattr(P, "PART_LEAST", 16)
    texts = {1: "many words of a long text, " * 45_000, 2: "short", 3: "x" * 300_000}
    df = spark.createDataFrame([(k, t, "s" if k < 3 else None) for k, t in texts.items()], "doc_id long, text string, source string")
    check(P.pack(df, tokenizer_path()).collect(), texts, tokenizer)


def test_cached_words_are_exact(tokenizer):
    cache = P.WordCache(tokenizer_path())
    for t in ["", " ", "a  b", "a \n b", "\n\n x", "don't  'll", "été\u00a0 x\u2003y", "a\tb", " lead", "trail ", "x   y", "12 34", "a\n \nb", "!!! ??", "日本 語"]:
        assert np.frombuffer(P.encode_text(t, cache), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


ADDED = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x\n <|endoftext|> \n y", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|", "<<|endoftext|>>", "x  <|endoftext|>  y", "<|ENDOFTEXT|> é<|endoftext|>日本"]


def test_added_tokens_are_exact(spark, tokenizer):
    """An added token inside a text keeps its own id, as the tokenizer has it."""
    assert 50256 in tokenizer.encode(ADDED[0], add_special_tokens=False).ids
    cache = P.WordCache(tokenizer_path())
    for t in ADDED:
        assert np.frombuffer(P.encode_text(t, cache), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(ADDED)], "doc_id long, text string, source string")
    check(P.pack(df, tokenizer_path()).collect(), dict(enumerate(ADDED)), tokenizer)


def test_words_are_the_tokenizer_s(tables, tokenizer):
    """Words encoded from the ranks have the ids of the tokenizer, on real texts and on random ones of all kinds of characters."""
    import random

    rng = random.Random(5)
    kinds = ["abz", "AZ", "019", " ", " \n", "\t\r\x0b\x1c\x85\u2003\u3000", "éßÅø", "日本語", "🙂👍🏽", "'sdtl", "!?.,-_#", "\u0301\u200d", "٣४", "Ⅳ½"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += [r["text"] for r in tables.documents.select("text").collect() if r["text"]]
    cache = P.WordCache(tokenizer_path())
    for t in texts:
        assert np.frombuffer(P.encode_text(t, cache), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:200])


def test_tail():
    assert P.tail_cuts(0) == [] and P.tail_cuts(700) == [512, 128, 32, 16, 8, 4]


def test_packing_odd(spark, odd, empty):
    rows = P.pack(odd, tokenizer_path()).collect()
    assert sum(r["start"] == 0 for r in rows) == 7 and P.pack(empty, tokenizer_path()).count() == 0
