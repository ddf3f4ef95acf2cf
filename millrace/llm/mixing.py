"""Mixing sources to target weights: repetition rates per source, then whole copies of documents.

rate = target / size of the source. Every document is emitted floor(rate) times, and once
more if its hash-seeded uniform number is below a threshold: the rate's fraction. With
``calibrate`` (the default) the threshold is the point of the source's own hash
distribution, weighted by size, at which the words drawn come nearest to the fraction:
the same Bernoulli draw with the sampling error of its sum taken out. Without it the
threshold is the fraction itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, without

#: A text's size counts these.
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the hash distribution that calibration looks at, for each source.
CELLS = 4096


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space: places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, cycle: tuple[int, ...], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights of ``cycle`` in turn, and share
    ``share`` of all sizes by weight; no target exceeds ``most`` times its source's size,
    and what is cut off is shared again. The fixed point is min(most * size, level *
    weight) for one level, found from the sources in order of size / weight. One row a
    source: the windows without partitions run over those rows only.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((place - 1) % len(cycle) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("full_cap", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("full_weight", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    t = t.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everything))
    t = t.withColumn("level", (F.col("goal") - F.col("full_cap")) / (F.col("all_weight") - F.col("full_weight")))
    # the first source whose cap is above the level of those before it, and all after it, share the rest
    t = t.withColumn("found", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything))
    return t.select("source", "source_size", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("found.level"))).alias("target"))


def uniform(seed: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) from an MD5 of the seed and the keys: 48 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *keys).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cycle: tuple[int, ...] = (5, 2, 1), most: float = 2.0, seed: str = "mix", calibrate: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size * copies), one row a row of ``docs``.

    Sizes are words. Rows of equal id draw the same number. Null and empty texts have
    size 0 and draw like others; a source of size 0 has rate 0 and no copies; null
    sources form one source, the last. Columns of the added names in ``docs`` are
    replaced. An empty table gives an empty table.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs = without(docs, *added, "__u", "__source")
    source = F.col(source_col).cast("string")
    u = uniform(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    thin = keep(docs.select(source.alias("source"), n_words(F.col(text_col)).alias("size"), u.alias("u")).groupBy("source", F.floor(F.col("u") * CELLS).cast("int").alias("cell")).agg(F.sum("size").alias("size")), "cells")
    rates = source_targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), share, cycle, most)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rates = rates.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("fraction", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    if calibrate:
        upto = Window.partitionBy("source").orderBy("cell")
        drawn = thin.withColumn("below", F.sum("size").over(upto)).join(rates.select(F.col("source").alias("s"), "source_size", "fraction"), F.col("source").eqNullSafe(F.col("s")))
        need = F.col("fraction") * F.col("source_size")
        edges = drawn.select("source", F.struct(F.abs(F.col("below") - need).alias("miss"), (F.col("cell") + 1).alias("edge")).alias("e"), need.alias("need"))
        best = edges.groupBy("source").agg(F.min("e").alias("e"), F.max("need").alias("need"))
        best = best.select(F.col("source").alias("s"), F.when(F.col("need") <= F.col("e.miss"), F.lit(0.0)).otherwise(F.col("e.edge") / F.lit(float(CELLS))).alias("threshold"))
        rates = rates.join(best, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    else:
        rates = rates.withColumn("threshold", F.col("fraction"))
    rates = keep(rates.select(F.col("source").alias("__s"), "source_size", "target", F.col("whole").alias("__whole"), F.col("threshold").alias("__threshold")), "rates")
    out = docs.withColumn("size", n_words(F.col(text_col))).withColumn("__u", u).withColumn("__source", source)
    out = out.join(rates, F.col("__source").eqNullSafe(F.col("__s")), "left")
    out = out.withColumn("copies", (F.col("__whole") + (F.col("__u") < F.col("__threshold")).cast("long")).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*docs.columns, *added)


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row ``copies`` times."""
    return mixed.filter("copies > 0").select(*columns, F.explode(F.expr("sequence(1, cast(copies as int))")).alias("__copy")).select(*columns)
