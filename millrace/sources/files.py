"""Files in and out: COPY, snapshots, sorted and bucketed layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json")
#: Rows of a bucket, about.
BUCKET_ROWS = 500_000


def copy_to(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", **options) -> None:
    """COPY table TO: text formats keep timestamps to the microsecond and nulls apart from empty strings."""
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt!r}")
    w = df.write.mode(mode).options(**options)
    if fmt == "csv":
        w = w.option("header", True).option("nullValue", "\\N").option("emptyValue", "").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("escape", '"').option("multiLine", True)
    w.format(fmt).save(path)


def copy_from(spark: SparkSession, path: str, schema, fmt: str = "csv", **options) -> DataFrame:
    """COPY table FROM with a given schema: no pass over the data to guess one."""
    r = spark.read.schema(schema).options(**options)
    if fmt == "csv":
        r = r.option("header", True).option("nullValue", "\\N").option("emptyValue", "").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("escape", '"').option("multiLine", True)
    return r.format(fmt).load(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options) -> DataFrame:
    """A table of another database, read in ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None, bloom: list[str] = ()) -> None:
    """Range-partitioned, sorted Parquet: min/max statistics then skip row groups for seeks and ranges, Bloom filters for seeks on ``bloom``."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    w = ranged.sortWithinPartitions(*keys).write.mode("overwrite")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def buckets_for(*frames: DataFrame, least: int = 4) -> int:
    """A number of buckets that tables to be joined share: it follows the rows of the largest, so no bucket grows with it."""
    return max(least, *[-(-df.count() // BUCKET_ROWS) for df in frames])


def write_buckets(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A table hashed into buckets, each one file of one task: joins and aggregates on the keys then need no exchange."""
    w = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(table)


def backup(tables: dict[str, DataFrame], path: str, codec: str = "zstd") -> None:
    """A full snapshot: one Parquet folder a table."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", codec).parquet(f"{path}/{name}")


def backup_since(df: DataFrame, path: str, version: str, since) -> None:
    """An incremental snapshot: the versions after ``since``."""
    df.filter(F.col(version) > F.lit(since)).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def restore(spark: SparkSession, path: str, *increments: str) -> DataFrame:
    """A snapshot and the increments on it, as one change log."""
    return spark.read.parquet(path, *increments)


def with_row_address(df: DataFrame) -> DataFrame:
    """File and row number in it: the nearest thing to a physical row id."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def key_scan(log: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """The newest value of each key between both ends, these included, in order, from a log (key, value, version)."""
    log = log if lo is None else log.filter(F.col("key") >= lo)
    log = log if hi is None else log.filter(F.col("key") <= hi)
    return log.groupBy("key").agg(F.max_by("value", "version").alias("value")).orderBy("key")
