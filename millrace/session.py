"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


class Tables:
    """The Parquet tables of a folder as attributes; nothing is read before a query runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, args=None, **frames: DataFrame) -> DataFrame:
        """Spark SQL in which {name} stands for a frame given here or for a table of the folder."""
        import string

        names = {f for _, f, _, _ in string.Formatter().parse(text) if f}
        return self.spark.sql(text, args=args, **{n: frames.get(n, None) if n in frames else getattr(self, n) for n in names})


def register_views(spark: SparkSession, folder: str, names=TABLES) -> None:
    """Temporary views of the tables of a folder, for plain SQL."""
    tables = Tables(spark, folder)
    for n in names:
        getattr(tables, n).createOrReplaceTempView(n)
