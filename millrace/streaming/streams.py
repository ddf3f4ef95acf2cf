"""Streams over folders of Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.matviews import AggregateView


def stream(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], measures: list[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates over event-time windows, batch or stream; rows later than ``late`` are dropped from a stream."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.groupBy(w.alias("w"), *keys).agg(*measures)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *grouped.columns[1:])


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], measures: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates over sessions: runs of events less than ``gap`` apart."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*measures)
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *grouped.columns[1:])


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first event of each key; a stream forgets keys after ``late``."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def apply_changes(changes: DataFrame, target: str, keys: list[str], version: str, op: str, checkpoint: str) -> StreamingQuery:
    """Append a change log (op: insert, update, delete; commit and abort rows are skipped) to a Parquet log, reduced.

    Each batch writes the newest change of each of its keys into a folder of its own:
    its cost is that of the batch, whatever the table holds. Replaying a batch after a
    failure writes the same folder again, so changes apply exactly once. ``current``
    reads the table, ``compact`` folds the folders.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        rows = batch.filter(F.lower(op).isin("insert", "update", "delete"))
        _newest(rows, keys, version).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("__v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"__v.{c}").alias(c) for c in rows.columns])


def current(spark: SparkSession, target: str, keys: list[str], version: str, op: str) -> DataFrame:
    """The newest row of each key that is not deleted."""
    return _newest(spark.read.parquet(target).drop("epoch"), keys, version).filter(F.lower(op) != "delete")


def compact(spark: SparkSession, target: str, into: str, keys: list[str], version: str, op: str) -> None:
    """The table as one folder under ``into``, without deleted rows: where a new log goes on from."""
    current(spark, target, keys, version, op).write.mode("errorifexists").parquet(f"{into}/epoch=-1")


def maintain(base: DataFrame, view: AggregateView, target: str, checkpoint: str) -> StreamingQuery:
    """Keep an aggregate view's partial results up to date with a stream of inserted rows."""
    spark = base.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        states = [view.partial(batch)] + ([spark.read.parquet(f"{target}/{epoch - 1}")] if epoch else [])
        view.merge(*states).write.mode("overwrite").parquet(f"{target}/{epoch}")

    return base.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(query: StreamingQuery, timeout: int = 300) -> int:
    """Wait for a query over the available data; the number of its last batch."""
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not end")
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return max(done, default=-1)
