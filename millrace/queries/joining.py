"""Joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return J.join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left_outer(t):
    return J.join(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderstatus <> 'O') o RIGHT JOIN lineitem ON o_orderkey = l_orderkey")
def join_right_outer(t):
    return J.join(t.orders.filter("o_orderstatus <> 'O'"), t.lineitem, [("o_orderkey", "l_orderkey")], "right").select("o_orderkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderstatus <> 'O') o FULL JOIN lineitem ON o_orderkey = l_orderkey")
def join_full_outer(t):
    return J.join(t.orders.filter("o_orderstatus <> 'O'"), t.lineitem, [("o_orderkey", "l_orderkey")], "full").select("o_orderkey", "l_orderkey", "l_linenumber")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    return J.cross(t.region, t.nation).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    cond = (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") != F.col("b.n_regionkey"))
    return J.theta(a, b, cond).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a LEFT JOIN nation b ON a.n_nationkey > b.n_nationkey + 20")
def join_theta_left(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return J.theta(a, b, F.col("a.n_nationkey") > F.col("b.n_nationkey") + 20, "left").select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def join_hash_equi(t):
    return J.join(t.lineitem, t.orders.filter("o_orderstatus = 'F'"), [("l_orderkey", "o_orderkey")], strategy="hash").select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def join_sort_merge(t):
    return J.join(t.lineitem, t.orders.filter("o_orderstatus = 'O'"), [("l_orderkey", "o_orderkey")], strategy="merge").select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_multiway(t):
    """Orders are summed by customer before they meet the dimensions."""
    spent = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    place = J.join(t.nation, t.region, [("n_regionkey", "r_regionkey")]).select("n_nationkey", "n_name", "r_name")
    who = J.join(t.customer, place, [("c_nationkey", "n_nationkey")]).select("c_custkey", "n_name", "r_name")
    return J.join(spent, who, [("o_custkey", "c_custkey")]).groupBy("r_name", "n_name").agg(F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


@query("SELECT s AS strategy, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('auto'), ('broadcast'), ('hash'), ('merge')) AS x(s) GROUP BY s")
def join_hint_equivalence(t):
    """The same rows under each strategy."""
    one = lambda s: J.join(t.orders, t.customer, [("o_custkey", "c_custkey")], strategy=s).agg(F.lit(s).alias("strategy"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return reduce(DataFrame.unionByName, map(one, ("auto", "broadcast", "hash", "merge")))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t):
    return J.join(t.customer, t.orders.filter("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t):
    return J.join(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], "anti").select("o_orderkey")


@query("""SELECT a.k AS a, b.k AS b, a.x AS x FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS x FROM nation) a
 JOIN (SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS x FROM nation) b ON a.x IS NOT DISTINCT FROM b.x""")
def join_null_safe(t):
    n = t.nation.select(F.col("n_nationkey").alias("k"), F.nullif(F.col("n_regionkey"), F.lit(1)).alias("x"))
    return J.join(n, n, [("x", "x")], null_safe=True).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"), F.col("l.x").alias("x"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join(t):
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("SELECT c_custkey, band FROM customer JOIN (SELECT * FROM (VALUES ('debt', -1000.0, -0.01), ('low', 0.0, 999.99), ('mid', 1000.0, 4999.99), ('high', 5000.0, 10000.0)) AS b(band, lo, hi)) ON c_acctbal BETWEEN lo AND hi")
def join_range(t):
    bands = t.spark.createDataFrame([("debt", -1000.0, -0.01), ("low", 0.0, 999.99), ("mid", 1000.0, 4999.99), ("high", 5000.0, 10000.0)], "band string, lo double, hi double")
    return J.range_join(t.customer, bands, "c_acctbal", "lo", "hi", 1000.0).select("c_custkey", "band")


@query("""SELECT a.event_id, a.user_id, b.value AS last_value, b.event_id AS last_event FROM (SELECT * FROM events WHERE event_type = 'error') a
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_as_of(t):
    """Each error with its user's last click before it."""
    kind = lambda k: t.events.filter(F.col("event_type") == k)
    clicks = kind("click").select("user_id", "ts", F.col("value").alias("last_value"), F.col("event_id").alias("last_event"))
    return J.as_of_join(kind("error"), clicks, ["user_id"], "ts", ["last_value", "last_event"]).select("event_id", "user_id", "last_value", "last_event")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal <= c_acctbal + 5 AND c_acctbal <= s_acctbal + 20")
def join_interval(t):
    """Suppliers [balance, + 20] and customers [balance, + 5] whose intervals overlap."""
    a = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 20).alias("hi"))
    b = t.customer.select("c_custkey", F.col("c_acctbal").alias("from"), (F.col("c_acctbal") + 5).alias("to"))
    return J.interval_join(a, b, ("lo", "hi"), ("from", "to"), 25.0).select("s_suppkey", "c_custkey")


@query("SELECT c_custkey, q.n, q.hi FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_custkey = c_custkey) q")
def join_lateral(t):
    return t.sql("SELECT c_custkey, q.n, q.hi FROM {customer}, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS hi FROM {orders} WHERE o_custkey = c_custkey) q")
