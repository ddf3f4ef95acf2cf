import hashlib
import unicodedata
import zlib

from millrace.llm import fingerprints as P
from millrace.llm import sharding as S


def canon(t):
    t = t or ""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(folded.split())


def test_fingerprints(spark, docs, corpus):
    got = {r["doc_id"]: r for r in P.edited_report(docs).collect()}
    n = len(corpus)
    edited = {}
    for d in range(n):
        t, nxt = corpus[d] or "", corpus[d - 1 if d else n - 1] or ""
        k = len(t) // 3
        edited[d] = t[: len(t) - k] + nxt[:k]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest()
        assert got[d]["near_edited"] == float(canon(t) == canon(edited[d])) and got[d]["near_next"] == float(canon(t) == canon(nxt))
    prints = [(canon(corpus[d] or ""), got[d]["fingerprint"]) for d in range(n)] + [(canon(edited[d]), got[d]["edited_fingerprint"]) for d in range(n)]
    assert len(set(prints)) == len({a for a, _ in prints}) == len({b for _, b in prints})
    own = {r["doc_id"]: r["fingerprint"] for r in P.fingerprint(docs).collect()}
    assert own == {d: got[d]["fingerprint"] for d in range(n)}


def test_folding(spark):
    texts = ["Straße  IV", "STRASSE\tⅣ", "ﬁn", "FIN", "e\u0301", "É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = [r["fingerprint"] for r in P.fingerprint(df).orderBy("doc_id").collect()]
    assert f[0] == f[1] and f[2] == f[3] and f[4] == f[5] and len(set(f)) == 3


def test_collisions(spark):
    """Texts forced into one bucket are told apart by their bytes."""
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "a"), (2, 2, "c"), (2, 2, "c")], "h1 long, h2 long, canon string")
    apart = P.collisions(rows)
    assert sorted((r["canon"], r["rank"]) for r in apart.collect()) == [("a", 0), ("b", 1)]
    settled = P.settle(rows, apart, "h1", "h2", "canon", "f").select("canon", "f").distinct().collect()
    assert len({r["f"] for r in settled}) == 3 and P.collisions(rows.filter("h1 = 2")) is None


def test_fingerprints_odd(spark, odd, empty):
    got = P.edited_report(odd).collect()
    assert len(got) == 7 and P.fingerprint(odd).count() == 7
    assert [r["near_next"] for r in got if r["doc_id"] is None] == [None]
    assert P.edited_report(empty).count() == 0 and P.fingerprint(empty).count() == 0


def test_one_document_follows_itself(spark):
    r = P.edited_report(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def check_shards(rows, shards, tolerance):
    total = sum(r["size"] for r in rows)
    most = max(r["size"] for r in rows)
    at = 0
    for k in range(shards):
        mine = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        at += sum(r["size"] for r in mine)
        assert abs(at - total * (k + 1) / shards) <= max(tolerance * total / shards, most)


def test_shards(spark, docs, corpus):
    rows = S.shard(docs, 5).collect()
    assert len(rows) == len(corpus)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    check_shards(rows, 5, 0.001)


def test_shards_on_a_real_table(spark, tables):
    rows = S.shard(tables.documents, 16).collect()
    check_shards(rows, 16, 0.001)
    from millrace.llm.queries import op3_sharding

    got = {r["doc_id"]: r for r in op3_sharding(spark, tables.folder).collect()}
    assert all(got[r["doc_id"]]["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and got[r["doc_id"]]["shard"] == r["shard"] for r in rows)


def test_hot_text_is_split(spark):
    df = spark.createDataFrame([(k, "same text" if k % 3 else f"text {k}") for k in range(3000)], "doc_id long, text string").repartition(4)
    rows = S.shard(df, 8).collect()
    check_shards(rows, 8, 0.001)
    assert len({r["shard"] for r in rows if r["text"] == "same text"}) > 4


def test_shards_odd(spark, odd, empty):
    rows = S.shard(odd, 4).collect()
    assert len(rows) == 7 and S.shard(empty, 4).count() == 0
    for k in range(4):
        mine = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert mine == list(range(len(mine)))
