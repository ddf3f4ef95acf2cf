"""Event-time windows and streams over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.matviews import AggregateView
from ..streaming import streams as S
from .registry import query
from .scans import _scratch


def n():
    return F.count(F.lit(1)).alias("n")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_tumbling(t):
    return S.tumbling(t.events, "ts", "1 hour", ["event_type"], [n()]).select("window_start", "event_type", "n")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) AS x(k) GROUP BY 1")
def event_sliding(t):
    return S.tumbling(t.events, "ts", "2 hours", [], [n()], slide="1 hour").select("window_start", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return S.sessions(t.events, "ts", "6 hours", ["user_id"], [n()]).select("user_id", "session_start", "n")


@query("SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def stream_incremental_view(t):
    """An aggregate view kept by a stream of inserted rows."""
    where = _scratch(t)
    t.events.select("event_type", "value").write.parquet(f"{where}/in")
    view = AggregateView(["event_type"], {"n": ("count", "*"), "lo": ("min", "value"), "hi": ("max", "value")})
    rows = S.stream(t.spark, f"{where}/in", "event_type string, value double")
    last = S.run_to_end(S.maintain(rows, view, f"{where}/out", f"{where}/log"))
    return view.finish(t.spark.read.parquet(f"{where}/out/{last}"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) q WHERE k = 1 AND event_type <> 'error'")
def stream_apply_changes(t):
    """A change log applied by a stream: 'error' deletes, all else upserts."""
    where = _scratch(t)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    t.events.select("user_id", "event_id", "value", op.alias("op")).write.parquet(f"{where}/in")
    changes = S.stream(t.spark, f"{where}/in", "user_id long, event_id long, value double, op string")
    S.run_to_end(S.apply_changes(changes, f"{where}/out", ["user_id"], "event_id", "op", f"{where}/log"))
    return S.current(t.spark, f"{where}/out", ["user_id"], "event_id", "op").select("user_id", "event_id", "value")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def stream_late_rows(t):
    """Windows of a stream that goes on after its watermark has passed all the rows that come then: they are dropped."""
    where, rows = _scratch(t), t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))

    def step(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{where}/out/{epoch}")

    for part in (rows.filter("ts >= '2024-01-15'"), rows.filter("ts < '2024-01-15'")):
        part.write.mode("append").parquet(f"{where}/in")
        counted = S.tumbling(S.stream(t.spark, f"{where}/in", rows.schema), "ts", "1 hour", [], [n()], late="10 minutes")
        S.run_to_end(counted.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start())
    out = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/out")
    return out.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.max_by("n", "epoch").alias("n"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(t):
    """Each user once, though the stream brings them many times within the watermark."""
    where = _scratch(t)
    t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{where}/in")
    events = S.stream(t.spark, f"{where}/in", "user_id long, ts timestamp")
    seen = S.first_seen(events, ["user_id"], "ts", "60 days")
    S.run_to_end(seen.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start())
    return t.spark.read.schema("user_id long").parquet(f"{where}/out")
