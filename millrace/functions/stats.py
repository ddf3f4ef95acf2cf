"""Statistics as queries: profiles, common values, histograms, sketches, correlation, selectivity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_PAGE = 100
#: Selectivities where statistics do not help.
RANGE_SELECTIVITY, DEFAULT_SELECTIVITY, LEAST, MOST = 0.25, 0.1, 0.0001, 1.0


def table_profile(df: DataFrame) -> DataFrame:
    """row_count and page_count."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("row_count"), F.ceil(n / ROWS_A_PAGE).cast("long").alias("page_count"))


def _by_value(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of one column: a scan of it alone, counted before it moves."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows, nulls, distinct, min, max (as strings) and avg_width.

    Each column is read by itself and reduced to its distinct values before it moves; no
    row is multiplied.
    """

    def one(c: str) -> DataFrame:
        width = F.sum(F.length(F.col("value").cast("string")) * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
        rows = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
        nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0).cast("long"))
        return _by_value(df, c).agg(F.lit(c).alias("column"), rows.alias("rows"), nulls.alias("nulls"), F.count("value").alias("distinct_values"), F.min("value").cast("string").alias("min_value"), F.max("value").cast("string").alias("max_value"), width.alias("avg_width"))

    return reduce(DataFrame.unionByName, map(one, columns))


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), "value").limit(k)


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v, n) with ``lane``, the number of its range: ranges cut at approximate percentiles of the raw column, so that values are counted once."""
    df = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    lanes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx("v", [k / lanes for k in range(1, lanes)], 10_000).alias("q")).first()["q"] if lanes > 1 else None
    ends = sorted(set(cuts or []))

    def place(lo: int, hi: int):  # a balanced tree of comparisons
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("v") <= F.lit(ends[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("lane", place(0, len(ends)))


def equi_depth(df: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """Histogram of buckets of ceil(n / buckets) rows each, of a column of numbers, dates or times.

    Values are counted first; running counts over the distinct values, range by range,
    place them, and each value spreads over the buckets that its rows reach. Neither all
    rows nor all values are sorted in one task: only one row a range is.
    """
    counts = _value_counts(df, column)
    totals = counts.groupBy("lane").agg(F.sum("n").alias("lane_n"))  # one row a range
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("lane", (F.sum("lane_n").over(Window.orderBy("lane")) - F.col("lane_n")).alias("before"), F.ceil(F.sum("lane_n").over(everything) / buckets).alias("size"))
    placed = counts.join(F.broadcast(starts), "lane").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("lane").orderBy("v")))
    first, last = F.floor((F.col("upto") - F.col("n")) / F.col("size")), F.floor((F.col("upto") - 1) / F.col("size"))
    spread = placed.withColumn("bucket", F.explode(F.sequence(first, last)))
    inside = F.least("upto", (F.col("bucket") + 1) * F.col("size")) - F.greatest(F.col("upto") - F.col("n"), F.col("bucket") * F.col("size"))
    return spread.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(inside).cast("long").alias("frequency"), F.count(F.lit(1)).alias("distinct_values"))


def equi_width(df: DataFrame, column: str, lo: float, hi: float, buckets: int) -> DataFrame:
    """Histogram of equal intervals; 0 and buckets + 1 hold what lies outside."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(lo), F.lit(hi), F.lit(buckets)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("frequency"))


def max_diff(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Histogram cut at the largest gaps between neighbouring distinct values (of a numeric column)."""
    counts = _value_counts(df, column)
    tops = counts.groupBy("lane").agg(F.max("v").alias("top"))  # one row a range
    tops = tops.select("lane", F.lag("top").over(Window.orderBy("lane")).alias("below"))
    before = F.coalesce(F.lag("v").over(Window.partitionBy("lane").orderBy("v")), F.col("below"))
    gaps = counts.join(F.broadcast(tops), "lane").withColumn("gap", F.col("v") - before)
    cuts = [r["v"] for r in gaps.filter("gap is not null").orderBy(F.desc("gap"), "v").limit(buckets - 1).collect()]  # buckets - 1 values
    bucket = reduce(lambda a, c: a + F.when(F.col("v") >= F.lit(c), 1).otherwise(0), sorted(cuts), F.lit(0)).cast("long")
    return counts.groupBy(bucket.alias("bucket")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("distinct_values"))


def v_optimal(df: DataFrame, column: str, buckets: int, cells: int = 256) -> DataFrame:
    """Histogram whose buckets differ least inside: cuts that minimise the summed squared error of the values' frequencies.

    Up to ``cells`` distinct values are cut exactly; more of them are first counted into
    so many runs of values, by an equi-depth histogram, and the cuts fall between runs.
    What comes to the driver is one row a cell, whatever the table.
    """
    counts = _value_counts(df, column)
    few = counts.select("v", "n").limit(cells + 1).count() <= cells
    runs = counts.select(F.col("v").alias("lo"), F.col("v").alias("hi"), F.col("n").alias("frequency"), F.lit(1).cast("long").alias("distinct_values")) if few else equi_depth(df, column, cells).drop("bucket")
    rows = runs.orderBy("lo", "hi").collect()
    per = [r["frequency"] / r["distinct_values"] for r in rows]
    weight = [r["distinct_values"] for r in rows]
    w, x, xx = [0.0], [0.0], [0.0]
    for p, k in zip(per, weight, strict=True):
        w.append(w[-1] + k)
        x.append(x[-1] + p * k)
        xx.append(xx[-1] + p * p * k)
    error = lambda i, j: xx[j] - xx[i] - (x[j] - x[i]) ** 2 / (w[j] - w[i])
    n, best = len(rows), {(0, 0): (0.0, [])}
    for b in range(1, min(buckets, n) + 1):
        for j in range(b, n + 1):
            best[b, j] = min((best[b - 1, i][0] + error(i, j), best[b - 1, i][1] + [i]) for i in range(b - 1, j) if (b - 1, i) in best)
    cuts = best[min(buckets, n), n][1] if n else []
    bucket = reduce(lambda a, c: a + F.when(F.col("lo") >= F.lit(rows[c]["lo"]), 1).otherwise(0), cuts[1:], F.lit(0)).cast("long")
    return runs.groupBy(bucket.alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("frequency").alias("frequency"), F.sum("distinct_values").alias("distinct_values"))


def approx_distinct(df: DataFrame, column: str, rsd: float = 0.02) -> DataFrame:
    return df.agg(F.approx_count_distinct(column, rsd).alias("distinct_values"))


def distinct_sketches(df: DataFrame, keys: list[str], column: str, lg_k: int = 12) -> DataFrame:
    """A mergeable HyperLogLog sketch of each group."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct counts of coarser groups from finer groups' sketches."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def correlation(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row a pair of columns: Pearson correlation times 100, as the catalog keeps it (-100 to 100)."""
    wide = df.agg(*[(F.corr(a, b) * 100).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])))


def equality_selectivity(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 / distinct values of each column, within bounds: the share of rows that an equality keeps."""
    share = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.when(F.count("value") > 0, 1.0 / F.count("value")).otherwise(F.lit(DEFAULT_SELECTIVITY))))
    return reduce(DataFrame.unionByName, [_by_value(df, c).agg(F.lit(c).alias("column"), share.alias("selectivity")) for c in columns])


def join_selectivity(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """1 / max of the distinct counts of both join columns."""
    both = reduce(DataFrame.unionByName, [f.agg(F.count_distinct(c).alias("d")) for f, c in ((a, x), (b, y))])
    return both.agg((1.0 / F.greatest(F.max("d"), F.lit(1))).alias("selectivity"))


def needs_analyze(changes: int, rows: int, age_hours: float) -> bool:
    """Statistics are stale after 1,000 changes, a fifth of the rows, or a day."""
    return changes >= 1000 or rows > 0 and changes / rows >= 0.2 or age_hours > 24
