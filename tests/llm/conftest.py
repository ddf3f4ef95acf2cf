import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators also use.
CLASH = {"size": 1, "score": 2, "kept": 3, "label": 4, "h1": 5, "id": 6, "component": 7, "doc": 8, "rank": 9, "removed": 10, "target": 11, "shard": 12, "n": 13, "band": 14, "fingerprint": 15, "n_words": 16}


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared lines and passages, nulls, empty and odd texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    out = []
    for _ in range(60):
        out.append("\n".join(sentence(rng, rng.randint(1, 30), words) for _ in range(rng.randint(1, 6))))
    base = sentence(rng, 80, words)
    for k in range(14):  # near copies of one text
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [out[3]] * 4 + [out[7]] * 2
    passage = sentence(rng, 60, words)
    out += [passage + "\n" + sentence(rng, rng.randint(5, 60), words) for _ in range(6)]
    out += [None, "", " ", "\n\n", "a", "é" * 30, "ß straße İ", "Ⅳ ﬁn", "x\u00a0y", "日本 語 テキスト", "a\tb  c\r\nd", " ".join(words) * 20]
    return out


@pytest.fixture
def docs(spark, corpus):
    rows = [(k, t, ["en", "fr", None][k % 3], [None, "b", "a", "c"][k % 4], None if t is None else len(t)) for k, t in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def odd(spark):
    """Null ids, rows that repeat, ties, and columns of clashing names."""
    rows = [(None, "null id", "en", "s", 7), (1, "one two three four five six", "en", None, 9), (1, "one two three four five six", "en", None, 9), (1, "another text of the same id", None, "s", 1), (2, None, None, None, None), (2, None, None, None, None), (3, "", "fr", "t", 0)]
    import pyspark.sql.functions as F

    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
