"""Versioned tables, constraints, materialized views, catalog, distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import catalog as K
from ..plans import constraints as C
from ..plans import distribution as D
from ..plans import matviews as M
from ..plans import versioned as V
from .registry import query
from .scans import _scratch

LOG = ["user_id", "event_id", "event_type", "value"]


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id <= 500) q WHERE k = 1 AND event_type <> 'error'""")
def mvcc_snapshot_read(t):
    return V.as_of(t.events.select(*LOG), ["user_id"], "event_id", 500, deleted=F.col("event_type") == "error")


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts < TIMESTAMP '2024-01-15') q WHERE k = 1")
def time_travel_as_of(t):
    return V.as_of(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "2024-01-15 00:00:00", inclusive=False)


@query("SELECT r.user_id, r.snapshot FROM (SELECT user_id, min(event_id) AS snapshot FROM events GROUP BY user_id) r JOIN (SELECT user_id, max(event_id) AS c FROM events WHERE event_id <= 600 GROUP BY user_id) w ON r.user_id = w.user_id WHERE c > snapshot")
def mvcc_conflict_detect(t):
    reads = t.events.groupBy("user_id").agg(F.min("event_id").alias("snapshot"))
    return V.conflicts(reads, t.events.filter("event_id <= 600").select("user_id", "event_id"), "user_id", "snapshot", "event_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, max(event_id) FILTER (event_id <= 700) OVER (PARTITION BY user_id) AS kept FROM events) q WHERE kept IS NULL OR event_id >= kept")
def vacuum_versions(t):
    return V.vacuum(t.events.select(*LOG), ["user_id"], "event_id", 700)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 22")
def versioned_table(t):
    """Two commits, and a version between them that was rolled back."""
    version = F.when(F.col("n_nationkey") < 20, 1).when(F.col("n_nationkey") >= 22, 3).otherwise(2)
    log = t.nation.select("n_nationkey", "n_name", version.alias("version"))
    return V.committed(log, t.spark.createDataFrame([(1,), (3,)], "version int"), "version").drop("version")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def fk_violations(t):
    return C.fk_violations(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_mktsegment <> 'BUILDING'"), [("o_custkey", "c_custkey")])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fk_cascade_delete(t):
    return C.delete_parents(t.customer, t.orders, [("o_custkey", "c_custkey")], F.col("c_acctbal") < 0, "cascade")[1].select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def fk_set_null(t):
    return C.delete_parents(t.customer, t.orders, [("o_custkey", "c_custkey")], F.col("c_acctbal") < 0, "set null")[1].select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def fk_set_default(t):
    return C.delete_parents(t.customer, t.orders, [("o_custkey", "c_custkey")], F.col("c_acctbal") < 0, "set default", {"o_custkey": 1})[1].select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 1000000)")
def fk_restrict(t):
    """No parent under the condition has children, so the delete passes."""
    return C.delete_parents(t.supplier, t.lineitem, [("l_suppkey", "s_suppkey")], F.col("s_suppkey") > 1000000, "restrict")[0].select("s_suppkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates(t):
    return C.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT 'x' AS column, count(*) FILTER (nullif(l_linenumber, 1) IS NULL) AS violations FROM lineitem UNION ALL SELECT 'l_orderkey', 0")
def not_null_violations(t):
    return C.not_null_violations(t.lineitem.withColumn("x", F.nullif(F.col("l_linenumber"), F.lit(1))), ["x", "l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT (l_discount <= 0.09)")
def check_violations(t):
    return C.check_violations(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"), F.col("l_discount") <= 0.09)


VIEW = M.AggregateView(["o_orderstatus"], {"n": ("count", "*"), "keys": ("sum", "o_orderkey"), "lo": ("min", "o_totalprice"), "hi": ("max", "o_totalprice"), "mean": ("avg", "o_totalprice")})
VIEW_SQL = "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders {} GROUP BY o_orderstatus"


def _views(t, base):
    views = M.MaterializedViews(t.spark, _scratch(t))
    views.create("v", VIEW, {"orders"}, lambda: base[0])
    return views


@query(VIEW_SQL.format(""))
def matview_create_query(t):
    return _views(t, [t.orders]).read("v").withColumn("mean", F.round("mean", 4))


@query(VIEW_SQL.format("WHERE o_orderpriority <> '1-URGENT'"))
def matview_stale_read(t):
    """A read after the base has changed and before the refresh: the old rows."""
    base = [t.orders.filter("o_orderpriority <> '1-URGENT'")]
    views = _views(t, base)
    base[0] = t.orders
    views.changed("orders")
    return views.read("v").withColumn("mean", F.round("mean", 4))


@query(VIEW_SQL.format(""))
def matview_refresh(t):
    base = [t.orders.filter("o_orderpriority <> '1-URGENT'")]
    views = _views(t, base)
    base[0] = t.orders
    views.changed("orders")
    views.refresh("v")
    return views.read("v").withColumn("mean", F.round("mean", 4))


@query(VIEW_SQL.format(""))
def matview_incremental(t):
    views = _views(t, [t.orders.filter("o_orderpriority <> '1-URGENT'")])
    views.refresh_with("v", t.orders.filter("o_orderpriority = '1-URGENT'"))
    return views.read("v").withColumn("mean", F.round("mean", 4))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def matview_incremental_select(t):
    views, big = M.MaterializedViews(t.spark, _scratch(t)), t.orders.filter("o_totalprice > 300000")
    views.create("big", lambda: big.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_totalprice"), {"orders"})
    views.refresh_with("big", big.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice"))
    return views.read("big")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_orderstatus, CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F') q GROUP BY 1")
def matview_deletes(t):
    """A view kept up to date with deleted and updated base rows; a group of which nothing is left goes."""
    views, o = M.MaterializedViews(t.spark, _scratch(t)), t.orders
    views.create("v", M.AggregateView(["o_orderstatus"], {"n": ("count", "*"), "total": ("sum", "o_totalprice")}), {"orders"}, lambda: o)
    gone, high = o.filter("o_orderpriority = '1-URGENT' or o_orderstatus = 'F'"), o.filter("o_orderpriority = '2-HIGH' and o_orderstatus <> 'F'")
    views.refresh_without("v", gone.unionByName(high), high.withColumn("o_totalprice", F.col("o_totalprice") + 5))
    return views.read("v").withColumn("total", F.round("total", 2))


@query("SELECT * FROM (VALUES ('created', FALSE), ('base changed', TRUE), ('refreshed', FALSE), ('aged', TRUE)) AS x(step, needs)")
def matview_needs_refresh(t):
    views, steps = _views(t, [t.nation.select(F.lit("x").alias("o_orderstatus"), F.col("n_nationkey").alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"))]), []
    steps.append(("created", views.needs_refresh("v", 1e9)))
    views.changed("orders")
    steps.append(("base changed", views.needs_refresh("v", 1e9)))
    views.refresh("v")
    steps.append(("refreshed", views.needs_refresh("v", 1e9)))
    steps.append(("aged", views.needs_refresh("v", -1.0)))
    return t.spark.createDataFrame(steps, "step string, needs boolean")


def _catalog(t) -> K.Catalog:
    c = K.Catalog(t.spark)
    c.register("region", t.region, primary_key=["r_regionkey"])
    c.register("nation", t.nation, primary_key=["n_nationkey"], foreign_keys=[("nation_region", ["n_regionkey"], "region", ["r_regionkey"], "CASCADE", "NO ACTION")])
    c.create_index("nation_name", "nation", ["n_name"])
    return c


@query("SELECT * FROM (VALUES ('main', 'region', CAST(2 AS BIGINT)), ('main', 'nation', 3)) AS x(table_schema, table_name, column_count)")
def catalog_tables(t):
    return _catalog(t).sys_tables()


@query("""SELECT 'main' AS table_schema, * FROM (VALUES ('region', 'r_regionkey', CAST(1 AS BIGINT), 'int', 'YES'), ('region', 'r_name', 2, 'string', 'YES'), ('nation', 'n_nationkey', 1, 'int', 'YES'),
 ('nation', 'n_name', 2, 'string', 'YES'), ('nation', 'n_regionkey', 3, 'int', 'YES')) AS x(table_name, column_name, ordinal_position, data_type, is_nullable)""")
def info_schema_columns(t):
    c = _catalog(t)
    c.create_views()
    return t.spark.sql("SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable FROM information_schema_columns ORDER BY table_name, ordinal_position")


@query("SELECT 'main' AS constraint_schema, * FROM (VALUES ('region_pkey', 'region', 'PRIMARY KEY'), ('nation_pkey', 'nation', 'PRIMARY KEY'), ('nation_region', 'nation', 'FOREIGN KEY')) AS x(constraint_name, table_name, constraint_type)")
def info_schema_constraints(t):
    return _catalog(t).table_constraints()


@query("SELECT 'main' AS constraint_schema, 'nation_region' AS constraint_name, 'region_pkey' AS unique_constraint_name, 'NO ACTION' AS update_rule, 'CASCADE' AS delete_rule")
def info_schema_referential(t):
    return _catalog(t).referential_constraints()


@query("SELECT 'main' AS constraint_schema, * FROM (VALUES ('region_pkey', 'region', 'r_regionkey', CAST(1 AS BIGINT)), ('nation_pkey', 'nation', 'n_nationkey', 1), ('nation_region', 'nation', 'n_regionkey', 1)) AS x(constraint_name, table_name, column_name, ordinal_position)")
def info_schema_key_usage(t):
    return _catalog(t).key_column_usage()


@query("SELECT CAST(o_orderkey % 4 AS BIGINT) AS shard, count(*) AS rows FROM orders GROUP BY 1")
def shard_hash_counts(t):
    return D.shard_counts(t.orders, D.hash_shard(F.col("o_orderkey"), 4))


@query("SELECT CAST(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS BIGINT) AS shard, count(*) AS rows FROM orders GROUP BY 1")
def shard_range_counts(t):
    days = [F.lit(d).cast("timestamp") for d in ("1996-01-01", "1998-01-01")]
    where = sum((F.when(F.col("o_orderdate") >= d, 1).otherwise(0) for d in days[1:]), F.when(F.col("o_orderdate") >= days[0], 1).otherwise(0))
    return D.shard_counts(t.orders, where.cast("long"))


@query()
def shard_consistent_counts(t):
    return D.shard_counts(t.orders, D.consistent_shard(F.col("o_orderkey"), 4))


@query("SELECT count(*) AS shards, min(rows) AS smallest, max(rows) AS largest, max(rows) - min(rows) <= 1 AS balanced FROM (SELECT o_orderkey % 4 AS s, count(*) AS rows FROM orders GROUP BY 1) q")
def shard_balance(t):
    return D.balance(D.shard_counts(t.orders, D.hash_shard(F.col("o_orderkey"), 4)))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def distributed_fragments(t):
    parts = D.fragments(t.lineitem, D.hash_shard(F.col("l_orderkey"), 3), ["l_returnflag"], [F.sum("l_linenumber").alias("total")])
    return parts.groupBy("l_returnflag").agg(F.sum("total").alias("total"))
