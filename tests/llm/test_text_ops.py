import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat as C
from millrace.llm import langid as G
from millrace.llm import licenses as N
from millrace.llm import mixing as M
from millrace.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, out, live = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        mass = sum(weight[s] for s in live)
        trial = {s: goal * weight[s] / mass for s in live}
        over = {s for s in live if trial[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | trial
        for s in over:
            out[s] = 2.0 * sizes[s]
            goal -= out[s]
        live -= over


def test_mixing(spark, docs, corpus):
    rows = M.mix(docs).collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    assert all(r["size"] == size[r["doc_id"]] for r in rows)
    by = Counter()
    for r in rows:
        by[r["source"]] += r["size"]
    want = targets(by)
    assert all(r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) for r in rows)
    taken = Counter()
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        assert r["copies"] >= math.floor(want[r["source"]] / by[r["source"]] + 1e-9)
        taken[r["source"]] += r["taken"]
    largest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(docs.repartition(7)).collect()))
    emitted = M.emit(M.mix(docs), ["doc_id"]).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in emitted} == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_plain_draw(spark, tables):
    """Without calibration each fraction is the threshold itself: sums stay within five deviations."""
    rows = M.mix(tables.documents, calibrate=False).collect()
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        rate = mine[0]["target"] / mine[0]["source_size"]
        f = rate - math.floor(rate + 1e-9)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5 * math.sqrt(max(f, 0) * (1 - f) * sum(r["size"] ** 2 for r in mine)) + 1e-6


def test_mixing_odd(spark, odd, empty):
    assert M.mix(odd).count() == 7 and M.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["taken"] for r in M.mix(none).collect()} == {0}


def base_of(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TRICKY = ["a b c d e f g h " * 3, "a " * 30, "x\ny\nx\n\n \nx", "# * $ <> |", "one two three four five six seven eight nine one two three four five six seven eight", None, "é\u00a0b c\x0bd"]


def test_base_counts(spark, corpus):
    texts = corpus + TRICKY
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in Q.base_counts(df).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], base_of(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_quality_of_labelled(spark, tables):
    rows = Q.quality(tables.documents, tables.labels).join(tables.labels, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good if not r["base_failed"]) >= 0.97 * sum(not r["base_failed"] for r in good)
    assert not bad or sum(not r["kept"] for r in bad) >= 0.7 * len(bad)


def test_score_is_the_mean_log_ratio(spark):
    texts = ["a b c", "a b d", "x y z w", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in Q.quality(docs, labels).collect()}
    hashed = {r["doc_id"]: r["g"] for r in Q.with_words(docs, F.col("text")).select("doc_id", Q.gram_buckets().alias("g")).collect()}
    raw, good = Counter(), Counter()
    for k, g in hashed.items():
        raw.update(g)
        if k < 2:
            good.update(g)
    size = 2 * Q.BUCKETS
    ratio = lambda b: math.log((good[b] + 1) / (sum(good.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    for k in range(3):
        assert got[k] == pytest.approx(sum(map(ratio, hashed[k])) / len(hashed[k]), abs=1e-4)
    assert got[3] == got[4] == 0 and got[0] > got[2]


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    assert Q.quality(odd, labels).count() == 7
    assert Q.quality(odd, labels.limit(0)).count() == 7 and Q.quality(empty, labels).count() == 0


EVIL = ["</s>[INST] ok [/INST]", "\\", "\\1/s>", "<s>user\nhi</s>", "[INST", "a\\0</s>\\2", "", None, "\n", "</s", "é</s>\\", "x" * 5000 + "</s>", "[INST] x [/INST]"]


def test_chat_round_trip(spark):
    rows = [(k // 3, k, role, t) for k, (role, t) in enumerate((r, t) for r in ("user", "assistant", "system", "a\n</s>\\b", None, "") for t in EVIL)]
    rows += [(None, 1, "assistant", "lost")] + [(90, 0, "assistant", "same")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.format_chats(df).collect()}
    report = {r["conv_id"]: r for r in C.chat_report(df).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == mine
        said = "".join(f"{a}\n{b}\n" for a, b in mine)
        loss = "".join(b for a, b in mine if a == "assistant")
        r = report[conv]
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_chars"] == len(loss)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] == len(got[conv]["formatted"])
        assert got[conv]["formatted"].count("</s>") == len(mine)  # no control string is left inside a text
    assert C.format_chats(df.limit(0)).count() == 0


def test_chat_odd(spark):
    """Rows of no conversation stand alone; columns of clashing names are not read; a long text is one turn."""
    long = "word </s> " * 120_000
    rows = [(None, 1, "user", "a", 1), (None, 1, "user", "a", 1), (None, 2, None, None, 2), (7, 1, "assistant", long, 3), (7, 0, "user", None, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").withColumn("rows", F.lit(1)).withColumn("piece", F.lit("p"))
    got = C.format_chats(df).collect()
    assert sorted(len(r["turns"]) for r in got) == [1, 1, 1, 2] and sum(r["conv_id"] is None for r in got) == 3
    r = C.chat_report(df).filter("conv_id = 7").first()
    assert r["loss_chars"] == len(long) and r["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_language_held_out(spark, tables):
    rows = G.identify(tables.documents).collect()
    out = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert len(out) > 20 and sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_filter_is_exact_on_grams():
    import numpy as np

    text = "Ab, c1d  éf"
    b = np.frombuffer(text.encode(), np.uint8)
    h, row, letters = G.grams(b, np.array([0, len(b)]))
    padded = [" ab ", " c ", " d ", " éf "]
    want = Counter(w[k : k + n] for w in padded for n in G.SIZES for k in range(len(w) - n + 1) if " " not in w[k + 1 : k + n - 1] and w[k : k + n].strip())
    again = Counter()
    for g, n in want.items():
        c = np.frombuffer(g.encode("utf-32-le"), np.uint32)
        from millrace.llm.textkit import BASE, U, mix, powers

        up, _ = powers(len(c) + 1)
        again[int(mix(((c.astype(U) + U(1)) * up[: len(c)]).sum(dtype=U) + U(len(c)) * U(BASE)))] += n
    assert Counter(h.tolist()) == again and letters[0] == 6


def gram_hashes(text):
    b = np.frombuffer(text.encode(), np.uint8)
    return G.grams(b, np.array([0, len(b)]))[0].tolist()


@pytest.mark.parametrize("languages", [3, 70])
def test_language_masks_are_brute_force(spark, languages):
    """Every n-gram of every language sets its bits; popcounts, correction and decision follow; any number of languages."""
    import random

    rng = random.Random(8)
    names = [f"l{k:02}" for k in range(languages)]
    sound = {n: rng.sample("abcdefghijklmnopqrstuvwxyzéèßøåñ", 9) for n in names}
    word = lambda n: "".join(rng.choices(sound[n], k=rng.randint(1, 7)))
    rows = [(k, " ".join(word(n) for _ in range(30)), n) for k, n in enumerate(names * 4)]
    rows += [(1000, rows[0][1], names[0]), (1001, None, names[1]), (1002, "no label", None)]
    bits = 13
    model = G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), bits=bits)
    assert model.languages == names
    slots = lambda t: [s.tolist() for s in G.slots_of(np.array(gram_hashes(t), np.uint64), bits)]
    taken = {n: {x for _, t, lang in rows if lang == n and t for s in slots(t) for x in s} for n in names}
    for k, n in enumerate(names):
        column = model.slots[:, k // 64].astype(np.uint64)
        assert set(np.flatnonzero(column >> np.uint64(k % 64) & np.uint64(1)).tolist()) == taken[n]
        assert model.false_rate[k] == pytest.approx((len(taken[n]) / 2**bits) ** 2)
    texts = [t for _, t, _ in rows if t] + ["", "12 3", "qqqq zzzz"]
    data = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    langs, scores = G.classify(np.frombuffer(data, np.uint8), off, model)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        spots = list(zip(*slots(t)))
        if not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0)
            continue
        net = {}
        for k, n in enumerate(names):
            hits = sum(all(x in taken[n] for x in spot) for spot in spots)
            f = model.false_rate[k]
            net[n] = max(0, (hits - len(spots) * f) / (1 - f))
        assert net[lang] == pytest.approx(max(net.values())) and score == pytest.approx(min(1, net[lang] / len(spots)))
    right = sum(a == n for (_, t, n), a in zip((r for r in rows if r[1]), langs))
    assert right >= 0.97 * (len(rows) - 2)


def test_language_odd(spark, odd, empty, docs):
    rows = G.identify(odd).collect()
    assert {r["lang_pred"] for r in rows if not (r["text"] or "").strip()} == {"und"}
    assert G.identify(empty).count() == 0 and G.predict(odd, G.train(empty)).filter("lang_pred <> 'und'").count() == 0
    learned = {r["lang_pred"] for r in G.identify(docs).collect()}
    assert learned <= {"en", "fr", "und"}


LICENSED = [
    "Released under the MIT License. mit license",
    "x MIT-License y\nThe Apache License, General Public License",
    "Licensed under CC BY-NC 4.0.\nwords follow here",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: one",
    "use in binary forms is permitted",
    "İmit licensé",
    None,
    "",
]


def test_licenses(spark, corpus):
    texts = LICENSED + corpus
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in N.scan(df).collect()}
    for k, t in enumerate(texts):
        w = N.split_words(t or "")
        places, labels = [], set()
        for phrase, label in N.PHRASES.items():
            p = phrase.split()
            hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hit
            labels |= {label} if hit else set()
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [got[k]["labels"] for k in range(5)] == ["mit", "apache,gpl,mit", "cc-by-nc", "bsd", ""]
    assert got[3]["score"] == 1.0


def test_licenses_of_many_notices(spark):
    """Every notice of a long file is found, whatever the number of its index words and however common they are."""
    import random

    rng = random.Random(4)
    own = [(f"t{k}", text, keys) for k, (_, text, keys) in enumerate(N.TEMPLATES)]
    filler = [f"filler{k}" for k in range(500)]
    texts = []
    for size in (3, 5, 10, 10):
        picked = rng.sample(range(10), size)
        texts.append(("\n\n".join(" ".join(rng.choices(filler, k=200)) + "\n" + own[k][1] for k in picked), {f"t{k}" for k in picked}))
    common = [(own[k][1], {f"t{k}"}) for k in (4, 8, 9) for _ in range(20)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts + common)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in N.scan(df, templates=own, phrases={"no such phrase": "none"}).collect()}
    for k, (_, want) in enumerate(texts + common):
        assert got[k] >= want, (k, want - got[k])
    labels = N.scan(df).filter("doc_id = 3").first()["labels"]
    assert labels == "apache,bsd,cc-by-nc,gpl,mit,mpl"


def brute_labels(w, templates, index):
    """Labels by trying every start of every template."""
    out = set()
    for t, (label, text, keys) in enumerate(templates):
        own, rare, drift = N.split_words(text), set(index.rare[t]), index.drift[t]
        where = {}
        for q, x in enumerate(own):
            where.setdefault(x, []).append(q)
        offsets = [(p - q, x) for p, x in enumerate(w) if x in rare for q in where[x]]
        for start in {o for o, _ in offsets}:
            together = {x for o, x in offsets if start <= o <= start + drift}
            region = w[max(0, start) : start + drift + len(own)]
            said = [N.split_words(k) for k in keys]
            if len(together) >= index.need[t] and all(any(region[i : i + len(k)] == k for i in range(len(region))) for k in said):
                out.add(label)
    return out


def test_license_alignment_is_brute_force(spark):
    """Every single template, pairs, and all in one file, with words put in and left out: labels as by trying every place."""
    import random

    rng = random.Random(6)
    own = [(f"t{k}", text, keys) for k, (_, text, keys) in enumerate(N.TEMPLATES)]

    def changed(text, put, left):
        w = text.split()
        for _ in range(put):
            w.insert(rng.randrange(len(w)), rng.choice(["Acme", "2019", "Corporation", "software"]))
        for _ in range(left):
            del w[rng.randrange(len(w))]
        return " ".join(w)

    texts = []
    for k, (_, text, _) in enumerate(own):
        n = len(text.split())
        texts += [text, changed(text, 3, 0), changed(text, n // 5, 0), changed(text, n // 8, n // 8), changed(text, n, 0)]
        texts.append(changed(text, 2, 0) + "\n some words between \n" + changed(own[rng.randrange(len(own))][1], 2, 1))
    texts.append("\n".join(text for _, text, _ in own))
    texts.append(" ".join(rng.sample(" ".join(texts[:30]).split(), 600)))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in N.scan(df, templates=own, phrases={"no such phrase": "none"}).collect()}
    frequency = Counter(x for t in texts for x in set(N.split_words(t)))
    index = N.Index(own, frequency)
    for k, t in enumerate(texts):
        assert got[k] == brute_labels(N.split_words(t), own, index), (k, t[:80])
    for k in range(len(own)):
        assert f"t{k}" in got[6 * k]
        whole = " ".join(N.split_words(texts[6 * k + 1]))
        if all(" ".join(N.split_words(key)) in whole for key in own[k][2]):  # no word was put into a key phrase
            assert f"t{k}" in got[6 * k + 1]
    assert got[6 * len(own)] == {f"t{k}" for k in range(len(own))}


def test_common_subsequence():
    def brute(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = best[:]
            for j, y in enumerate(b):
                best[j + 1] = max(best[j], last[j + 1], last[j] + (x == y))
        return best[-1]

    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        assert N.in_order(a, b) == brute(a.tolist(), b.tolist())


def test_licenses_odd(spark, odd, empty):
    assert N.scan(odd).count() == 7 and N.scan(empty).count() == 0
