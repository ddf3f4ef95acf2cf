"""Quality rules: simple counts, and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are
counted, one from trusted documents and one from the whole corpus; a document's score is
the mean over its n-grams of log(p_trusted / p_corpus). A document is kept if its score
reaches a threshold that is fixed once, from labelled documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep, without

BUCKETS = 1 << 14
#: Labelled documents that the trusted multinomial and the threshold are fitted on, of each label.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r"
#: A trusted document that is rejected weighs so much more than a bad one that is kept.
CAUTION = 10.0


def with_words(docs: DataFrame, text: Column) -> DataFrame:
    """Adds __words (between ASCII white space) and __hashes."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ")
    docs = docs.withColumn("__words", F.array_remove(parts, ""))
    return docs.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))


def covered_by_repeats(docs: DataFrame, name: str, width: int = 8) -> DataFrame:
    """Adds the number of words in windows of ``width`` words that occur twice or more in the row.

    Windows are compared by a 64-bit hash of their words' hashes, sorted with their
    places; a run of equal hashes marks its places. All inside the row: n log n.
    """
    n = F.size("__hashes")
    windows = F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("__hashes", i, width)))).otherwise(F.array().cast("array<long>"))
    docs = docs.withColumn("__win", windows)
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    pairs = F.when(repeats, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    docs = docs.withColumn("__pairs", pairs).drop("__win")
    same = lambda p, j: F.coalesce(F.get("__pairs", j)["h"] == p["h"], F.lit(False))
    at = F.transform(F.filter("__pairs", lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"])
    docs = docs.withColumn("__at", F.sort_array(at)).drop("__pairs")
    spans = F.transform("__at", lambda x, k: F.least(F.lit(width), F.coalesce(F.get("__at", k + 1) - x, F.lit(width))))
    return docs.withColumn(name, F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("__at")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (and __hashes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    length = F.length(text)
    docs = with_words(docs, text)
    docs = docs.withColumn("n_words", F.size("__words").cast("long")).drop("__words")
    docs = docs.withColumn("word_chars", F.length(F.translate(text, SPACES + " ", "")).cast("long"))
    docs = docs.withColumn("n_symbols", (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    spoken = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES + " ", "")) > 0)
    docs = docs.withColumn("__lines", spoken).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    docs = covered_by_repeats(docs, "n_repeat_words")
    return docs.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def gram_buckets() -> Column:
    """Buckets of all words and pairs of words of __hashes."""
    single = F.transform("__hashes", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pair = F.transform(F.slice("__hashes", 1, F.greatest(F.size("__hashes") - 1, F.lit(0))), lambda h, i: (F.pmod(F.xxhash64(h, F.get("__hashes", i + 1)), F.lit(BUCKETS)) + BUCKETS).cast("int"))
    return F.concat(single, pair)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE) -> tuple[Column, float]:
    """(the log ratios by bucket, the threshold).

    The corpus multinomial counts every document. At most ``sample`` labelled documents
    of either label, those whose ids hash lowest, are trusted (1) or bad (0); they are
    what is broadcast. Without bad labels the threshold is the score that one in a
    hundred of the trusted falls below; without trusted ones nothing is rejected.
    """
    picked = None
    for q in (1, 0):
        ids = labels.filter(F.col(quality_col) == q).select(F.col(id_col).cast("long").alias("__id")).filter("__id is not null").distinct()
        ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample).withColumn("__q", F.lit(q))
        picked = ids if picked is None else picked.unionByName(ids)
    picked = keep(picked.groupBy("__id").agg(F.min("__q").alias("__q")), "picked")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), F.col("id") == F.col("__id"), "left")
    grams = with_words(texts.select("__q", "text"), F.col("text")).select("__q", F.explode(gram_buckets()).alias("g"))
    counts = keep(grams.groupBy("g").agg(F.count("*").alias("raw"), F.sum((F.coalesce("__q", F.lit(0)) == 1).cast("long")).alias("good")), "grams")
    every = docs.sparkSession.range(2 * BUCKETS).join(counts, F.col("id") == F.col("g"), "left").select("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    raw, good = every.agg(F.sum("raw"), F.sum("good")).first()
    ratio = F.log((F.col("good") + 1.0) / F.lit(float(good + 2 * BUCKETS))) - F.log((F.col("raw") + 1.0) / F.lit(float(raw + 2 * BUCKETS)))
    ratios = [r["r"] for r in every.orderBy("id").select(ratio.alias("r")).collect()]  # 32,768 numbers, whatever the corpus
    model = F.split(F.lit(",".join(f"{r:.4f}" for r in ratios)), ",").cast("array<double>")
    if not good:
        return model, float("-inf")
    judged = with_words(texts.filter("__q is not null").select("__q", "text"), F.col("text")).select("__q", score(model).alias("s"))
    cells = judged.groupBy(F.round("s", 3).alias("s")).agg(F.sum(F.col("__q")).alias("good"), F.sum(1 - F.col("__q")).alias("bad")).orderBy("s").collect()
    return model, cut(cells)


def cut(cells) -> float:
    """The threshold that costs least, from rising (s, good, bad): CAUTION a share of good ones lost, 1 a share of bad ones kept."""
    good, bad = sum(c["good"] for c in cells), sum(c["bad"] for c in cells)
    if not bad:
        lost = 0
        for c in cells:
            lost += c["good"]
            if lost > 0.01 * good:
                return c["s"] - 0.0005
    best, lost, out = None, 0, 0
    for k, c in enumerate(cells):
        cost = CAUTION * lost / good + (bad - out) / bad
        # in the middle of the gap below this score
        at = c["s"] - 0.0005 if not k else (cells[k - 1]["s"] + c["s"]) / 2
        if best is None or cost < best[0]:
            best = cost, at
        lost, out = lost + c["good"], out + c["bad"]
    return best[1]


def score(model: Column) -> Column:
    """Mean log ratio of the n-grams of __hashes; 0 for a text without words."""
    each = F.transform(gram_buckets(), lambda g: F.get(model, g))
    return F.when(F.size("__hashes") > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * F.size("__hashes") - 1)).otherwise(F.lit(0.0))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Null texts are empty: they have 0 words, fail and are not kept. Columns of the added
    names in ``docs`` are replaced; rows are judged one by one, so repeated rows agree.
    A text is judged whole: its words and their hashes stand in one row, some 60 times its
    bytes of memory. An empty table gives an empty table.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    docs = without(docs, *added, "__words", "__hashes")
    model, threshold = fit(docs, labels, id_col, text_col, **how)
    out = base_counts(docs, text_col).withColumn("score", score(model)).drop("__hashes")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
