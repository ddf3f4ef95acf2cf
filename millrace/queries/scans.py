"""Scans, sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import files
from .registry import query


@query("SELECT * FROM nation")
def scan_full(t):
    return t.nation.select("*")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def scan_point_lookup(t):
    return R.point_lookup(t.orders, "o_orderkey", 42)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 250 ORDER BY o_orderkey")
def index_range_scan(t):
    return R.range_scan(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 250)


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def index_prefix_scan(t):
    return R.prefix_scan(t.customer.select("c_custkey", "c_name"), "c_name", "Customer#00000001")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Alice', CAST(30 AS BIGINT)), (2, 'Bob', 28), (3, 'Eve', NULL)) AS u(id, name, age)")
def values_inline(t):
    return R.values(t.spark, [(1, "Alice", 30), (2, "Bob", 28), (3, "Eve", None)], "id long, name string, age long")


def _scratch(t) -> str:
    """A new folder in the shared folder of the session, else a local one."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def copy_roundtrip(t):
    path, df = _scratch(t), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    files.copy_to(df, path)
    return files.copy_from(t.spark, path, df.schema)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey BETWEEN 10 AND 20")
def sorted_layout_seek(t):
    """The rows that a sorted layout with a Bloom filter finds."""
    path = _scratch(t)
    files.write_sorted(t.customer, path, ["c_custkey"], 4, bloom=["c_custkey"])
    return R.range_scan(t.spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 10, 20, ordered=False)


@query("SELECT * FROM supplier")
def backup_restore(t):
    path = _scratch(t)
    files.backup({"supplier": t.supplier}, path)
    return files.restore(t.spark, f"{path}/supplier")


@query("SELECT k AS key, v AS value FROM (VALUES ('a', '3'), ('b', '2'), ('c', '5')) AS x(k, v)")
def key_value_scan(t):
    log = R.values(t.spark, [("a", "1", 1), ("b", "2", 1), ("d", "9", 1), ("a", "3", 2), ("c", "5", 2)], "key string, value string, version long")
    return files.key_scan(log, "a", "c")


@query("SELECT to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name)) AS json FROM nation")
def json_rows(t):
    return t.nation.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("json").cast("string"))


@query("SELECT 'orc' AS fmt, * FROM customer UNION ALL SELECT 'json', * FROM customer UNION ALL SELECT 'parquet', * FROM customer")
def copy_formats(t):
    """COPY out and in again in each format that keeps types."""
    path, out = _scratch(t), None
    for fmt in ("orc", "json", "parquet"):
        files.copy_to(t.customer, f"{path}/{fmt}", fmt)
        back = files.copy_from(t.spark, f"{path}/{fmt}", t.customer.schema, fmt).select(F.lit(fmt).alias("fmt"), "*")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (17, 42)")
def bloom_seek(t):
    """Equality on a column with a Bloom filter: row groups without the keys are skipped."""
    path = _scratch(t)
    files.write_sorted(t.customer, path, ["c_name"], 4, bloom=["c_custkey"])
    return t.spark.read.parquet(path).filter(F.col("c_custkey").isin(17, 42)).select("c_custkey", "c_name")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def bucketed_join(t):
    """Two tables in buckets of their key: the join needs no exchange."""
    path, made, buckets = _scratch(t), [], files.buckets_for(t.orders, t.lineitem)
    for name, df, key in (("orders", t.orders, "o_orderkey"), ("lineitem", t.lineitem, "l_orderkey")):
        table = f"millrace_bucketed_{name}_{uuid.uuid4().hex}"
        files.write_buckets(df, table, [key], buckets, f"{path}/{name}")
        made.append(t.spark.table(table))
    return made[0].hint("merge").join(made[1], F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query("SELECT event_id, user_id, value FROM events")
def backup_incremental(t):
    """A snapshot up to a version and the increment after it, restored as one log."""
    path, log = _scratch(t), t.events.select("event_id", "user_id", "value")
    files.backup({"log": log.filter("event_id <= 700")}, path)
    files.backup_since(log, f"{path}/increment", "event_id", 700)
    return files.restore(t.spark, f"{path}/log", f"{path}/increment")
