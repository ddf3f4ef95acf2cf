"""Canonical exact digests of documents, in DataFrame functions alone.

Canonical form: NFKC, full case folding, NFKC again, and white space as single spaces.
The digest is two xxhash64 of it under different seeds (128 bits). Texts of equal digest
are compared byte by byte: inside each bucket the least and the greatest canonical text
must be the same bytes; where they are not, the texts of the bucket are told apart by
their rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, without

def canonical(text: Column) -> Column:
    """The canonical form; null as empty. ASCII texts need no normalisation and fold by lower-casing."""
    # ICU classes of Spark's own distribution, called by its SQL function reflect
    text = F.coalesce(text, F.lit(""))
    once = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    fold = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), once, F.lit(True))
    again = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), fold, F.lit(True))
    plain = F.length(text) == F.octet_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(again), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), canon), F.xxhash64(F.lit(2), canon)


def digest_text(h1: Column, h2: Column, rank: Column) -> Column:
    """32 hex digits, and the rank behind them if the bucket holds several texts."""
    hexed = F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))
    return F.when(rank > 0, F.concat(hexed, F.lit("-"), rank.cast("string"))).otherwise(hexed)


def native_filter(members: DataFrame, column: str):
    """A function Column -> Column, true for every long in ``members[column]``: a Bloom filter of 4 million bits.

    Its 65,536 words travel as one array, whatever the number of members; more of them
    let more rows pass, and the exact join behind it decides.
    """
    spot = members.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(1 << 22)) for k in (5, 6)])).alias("p"))
    words = spot.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    dense = members.sparkSession.range(1 << 16).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))
    table = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("t"))
    packed = table.scalar()

    def apply(c: Column) -> Column:
        def bit(k):
            p = F.pmod(F.xxhash64(F.lit(k), c), F.lit(1 << 22))
            return F.getbit(packed[(p / 64).cast("int")], (p % 64).cast("int")) == 1

        return bit(5) & bit(6)

    return apply


def several(hashes: DataFrame) -> DataFrame:
    """(h1, h2) of the buckets of more than one row."""
    return keep(hashes.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "several")


def collisions(rows: DataFrame) -> DataFrame | None:
    """(h1, h2, canon, rank): every canonical text of the buckets that hold more than one; None if there are none.

    ``rows``: (h1, h2, canon). They are compared as partial minima and maxima, so a bucket
    of any number of copies costs each task one text, and only that moves.
    """
    mixed = rows.groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).filter("lo <> hi").select("h1", "h2")
    mixed = keep(mixed, "collisions")
    if mixed.isEmpty():
        return None
    apart = rows.join(mixed, ["h1", "h2"], "left_semi").distinct()
    return keep(apart.withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1), "apart")


def settle(hashed: DataFrame, apart: DataFrame | None, h1: str, h2: str, canon: str, name: str) -> DataFrame:
    """``hashed`` with the fingerprint ``name``; ``apart``: what ``collisions`` found, None if nothing."""
    if apart is None:
        return hashed.withColumn(name, digest_text(F.col(h1), F.col(h2), F.lit(0)))
    a = apart.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("canon").alias("__canon"), F.col("rank").alias("__rank"))
    out = hashed.join(a, (F.col(h1) == F.col("__h1")) & (F.col(h2) == F.col("__h2")) & (F.col(canon) == F.col("__canon")), "left")
    return out.withColumn(name, digest_text(F.col(h1), F.col(h2), F.coalesce("__rank", F.lit(0)))).drop("__h1", "__h2", "__canon", "__rank")


def canonical_rows(texts: DataFrame) -> DataFrame:
    """(h1, h2, canon) of a frame (text)."""
    a, b = wide_hash(F.col("canon"))
    return texts.select(canonical(F.col("text")).alias("canon")).select(a.alias("h1"), b.alias("h2"), "canon")


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``: equal for texts of equal canonical form, and for no others.

    A null text counts as empty. A column of that name in ``docs`` is replaced.
    """
    rows = canonical_rows(docs.select(F.col(text_col).alias("text")))
    multi = several(rows.select("h1", "h2"))
    apart = collisions(rows.filter(native_filter(multi, "h1")(F.col("h1"))))
    a, b = wide_hash(F.col("__c"))
    out = without(docs, "fingerprint", "__c", "__a", "__b").withColumn("__c", canonical(F.col(text_col))).withColumn("__a", a).withColumn("__b", b)
    return settle(out, apart, "__a", "__b", "__c", "fingerprint").drop("__c", "__a", "__b")


#: Ids of a range, about.
RANGE = 1_000_000


def next_ids(ids: DataFrame, lanes: int) -> DataFrame:
    """(id, next_id) for different ids in falling order; the last is followed by the first.

    Ids are dealt to ``lanes`` ranges or more, so that none grows with the table; each
    range is ordered on its own, and its last id is followed by the first of the next
    range that has rows. No task sees all ids.
    """
    ids = keep(ids.select("id").distinct(), "ids")
    lanes = max(lanes, -(-ids.count() // RANGE))
    ranged = keep(ids.repartitionByRange(lanes, "id").withColumn("lane", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("lane").orderBy(F.desc_nulls_last("id"))
    tops = ranged.groupBy("lane").agg(F.max("id").alias("top"))  # one row a range
    down = Window.orderBy(F.desc("lane"))
    tops = tops.withColumn("after", F.coalesce(F.lead("top").over(down), F.max("top").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    out = ranged.withColumn("lead", F.lead("id").over(within)).join(tops.select("lane", "after"), "lane")
    return out.select("id", F.coalesce("lead", "after").alias("next_id"))


def edited(thin: DataFrame, follows: DataFrame) -> DataFrame:
    """(id, text, edited) of the documents (id, text) that ``follows`` (id, next_id) lists.

    Each document is dealt by its id once; only the start that the one before may need
    moves a second time.
    """
    sizes = thin.groupBy("id").agg(F.max(F.expr("cast(length(text) div 3 as int)")).alias("most"))
    asked = follows.join(sizes, "id").select("next_id", F.col("id").alias("for_id"), "most")
    heads = thin.join(asked, F.col("id") == F.col("next_id")).select("for_id", F.left(F.col("text"), F.col("most")).alias("head"))
    heads = heads.groupBy("for_id").agg(F.min("head").alias("head"))
    own = thin.join(heads, F.col("id") == F.col("for_id"))
    third = F.expr("cast(length(text) div 3 as int)")
    cut = F.expr("substring(text, 1, length(text) - cast(length(text) div 3 as int))")
    return own.select("id", "text", F.concat(cut, F.left(F.col("head"), third)).alias("edited"))


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the start of the next document).

    Next: the document of the next lower id, after the lowest the highest; of rows that
    repeat an id the least text stands for it. A row with a null id has no next document:
    its edited text is the text without its last third, and near_next is null. An exact
    digest is equal or it is not: likeness is 1 or 0. One row a row of ``docs``. Ids are
    whole numbers, or strings of digits; further columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    known = thin.filter("id is not null")
    follows = keep(next_ids(known, int(spark.conf.get("spark.sql.shuffle.partitions"))), "next")
    alone = thin.filter("id is null").select("id", "text", F.expr("substring(text, 1, length(text) - cast(length(text) div 3 as int))").alias("edited"))
    both = edited(known, follows).unionByName(alone)
    both = both.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"))
    (c1, c2), (e1, e2) = wide_hash(F.col("c")), wide_hash(F.col("e"))
    rows = keep(both.select("id", "n_chars", "edited_sha256", c1.alias("c1"), c2.alias("c2"), e1.alias("e1"), e2.alias("e2")), "hashed")

    ones, twos = rows.select(F.col("c1").alias("h1"), F.col("c2").alias("h2")), rows.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"))
    multi = several(ones.unionByName(twos))
    plain = canonical_rows(thin)
    plain = plain.filter(native_filter(multi, "h1")(F.col("h1")))
    # edited texts of shared buckets are made again from the documents that they need
    wanted = rows.join(multi, (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2")), "left_semi").filter("id is not null").select("id").distinct()
    wanted = keep(follows.join(wanted, "id", "left_semi"), "wanted")
    needed = native_filter(wanted.select("id").union(wanted.select("next_id")), "id")
    again = canonical_rows(edited(known.filter(needed(F.col("id"))), wanted).select(F.col("edited").alias("text")))
    apart = collisions(plain.unionByName(again))

    if apart is None:
        rows = rows.withColumn("fingerprint", digest_text(F.col("c1"), F.col("c2"), F.lit(0))).withColumn("edited_fingerprint", digest_text(F.col("e1"), F.col("e2"), F.lit(0)))
    else:  # two canonical texts of one digest: rows of these buckets need their text once more
        rows = both.withColumn("c1", c1).withColumn("c2", c2).withColumn("e1", e1).withColumn("e2", e2)
        rows = settle(settle(rows, apart, "c1", "c2", "c", "fingerprint"), apart, "e1", "e2", "e", "edited_fingerprint")
        rows = keep(rows.drop("c", "e"), "settled")
    after = rows.groupBy("id").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("id", "n")
    after = follows.join(after, F.col("next_id") == F.col("n")).select(F.col("id").alias("f"), "next_fingerprint")
    out = rows.join(after, F.col("id") == F.col("f"), "left")
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
