"""Texts above a megabyte, which make a chunk of their own, and the exact cuts and thresholds of small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, jaccard_join, langid, licenses, line_dedup, mixing, quality, sharding

from .test_text_ops import base_of


@pytest.fixture(scope="module")
def long():
    """1.3 MB of lines, two of them twice, one nearly twice."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghilmnoprstué", k=rng.randint(3, 9))) for _ in range(2000)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(15_000)]
    lines[9000], lines[14_000] = lines[10], lines[20]
    lines[14_900] = lines[30] + "x"
    return "\n".join(lines)


@pytest.fixture
def df(spark, long):
    changed = long.replace(" ", "  ", 1000)  # the same words
    near = long.split("\n")
    near[500] = "another line in this place"
    rows = [(1, long, "fr", "a"), (2, "a short text", "en", "b"), (3, changed, "fr", "a"), (4, "\n".join(near), "fr", "a"), (5, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_lines(df, long):
    r = by_id(line_dedup.line_dedup(df.filter("doc_id < 3")))[1]
    assert len(long) > 1 << 20 and [x["line"] for x in r["removed"]] == [9000, 14_000, 14_900] and r["n_kept"] == 14_997


def test_fingerprints(df):
    got = by_id(fingerprints.fingerprint(df))
    assert got[1]["fingerprint"] == got[3]["fingerprint"] != got[4]["fingerprint"]


def test_shards_and_mix(df):
    got = sharding.shard(df, 3).collect()
    assert sorted(r["size"] for r in got) == sorted(len((r["text"] or "").encode()) + 1 for r in df.collect())
    sizes = by_id(mixing.mix(df))
    assert sizes[1]["size"] == sizes[3]["size"] == 180_000 and sizes[1]["taken"] <= 360_000


def test_quality(df, long):
    r = by_id(quality.base_counts(df))[1]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_of(long)


def test_language(df):
    got = by_id(langid.identify(df))
    assert got[1]["lang_pred"] == got[4]["lang_pred"] and got[5]["lang_pred"] == "und"


def test_join(df):
    got = by_id(jaccard_join.jaccard_join(df))
    assert [(got[k]["class_id"], got[k]["n_links"], got[k]["n_copies"]) for k in (1, 2, 3, 4, 5)] == [(1, 2, 1), (2, 0, 0), (1, 2, 1), (1, 2, 0), (5, 0, 0)]


def test_licenses(spark, long):
    text = long + "\n" + licenses.TEMPLATES[10][1]
    r = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert r["labels"] == "mit" and r["n_words"] > 180_000 and r["score"] == 1.0


def test_splitters_are_brute_force(spark):
    """Shards are runs of the sorted rows, cut where a row's end is nearest to the even share or within tolerance of it."""
    rng = random.Random(2)
    rows = [(k, "x" * rng.choice((1, 3, 10, 60))) for k in range(400)] + [(k, "y" * 2000) for k in (500, 501)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).repartition(3)
    got = sorted(sharding.shard(df, 7).collect(), key=lambda r: (r["h"], r["doc_id"]))
    total, ends = sum(r["size"] for r in got), [0]
    for r in got:
        ends.append(ends[-1] + r["size"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    for k in range(1, 7):
        cut = ends[sum(r["shard"] < k for r in got)]
        nearest = min(abs(e - total * k / 7) for e in ends)
        assert abs(cut - total * k / 7) <= max(nearest, 0.001 * total / 7) + 1e-9


def test_threshold_is_brute_force(spark):
    """``kept`` follows from the cheapest of all thresholds between labelled scores."""
    rng = random.Random(3)
    good, bad = [f"good{k}" for k in range(40)], [f"bad{k}" for k in range(40)]
    mixed = lambda share: " ".join(rng.choice(good) if rng.random() < share else rng.choice(bad) for _ in range(40))
    shares = [rng.choice((0.1, 0.4, 0.5, 0.6, 0.9)) for _ in range(80)]
    docs = spark.createDataFrame([(k, mixed(s)) for k, s in enumerate(shares)] + [(900, "too short"), (901, None)], "doc_id long, text string")
    label = {k: int(rng.random() < s) for k, s in enumerate(shares) if k % 2}
    got = by_id(quality.quality(docs, spark.createDataFrame(list(label.items()), "doc_id long, quality int")))
    near = lambda x: math.copysign(math.floor(abs(x) * 1000 + 0.5) / 1000, x)
    scores = {k: near(got[k]["score"]) for k in label}
    cells, n = sorted(set(scores.values())), sum(label.values())
    trials = []
    for k, c in enumerate(cells):
        at = c - 0.0005 if not k else (cells[k - 1] + c) / 2
        lost = sum(label[d] for d in label if scores[d] < at)
        stays = sum(1 - label[d] for d in label if scores[d] >= at)
        trials.append((quality.CAUTION * lost / n + stays / (len(label) - n), k, at))
    at = min(trials)[2]
    assert 0 < n < len(label)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= at) for r in got.values())
    assert not got[900]["kept"] and not got[901]["kept"] and 0 < sum(r["kept"] for r in got.values()) < 80
