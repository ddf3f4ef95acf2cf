"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def sort_single(t):
    return R.sort(t.nation.select("n_nationkey", "n_name"), [("n_name", "asc")])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey")
def sort_multi_key(t):
    return R.sort(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), [("o_orderstatus", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def limit_n(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(5).limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def top_k(t):
    return R.top_k(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 20)


@query("SELECT o_orderstatus, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders) q WHERE rank <= 3")
def top_k_per_group(t):
    return R.top_k_per_group(t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 3)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return R.union_all(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return R.union_distinct(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def intersect_op(t):
    return R.intersect(t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")), t.part.filter("p_size < 10").select(F.col("p_partkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_op(t):
    return R.subtract(t.part.select(F.col("p_partkey").alias("k")), t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all_op(t):
    return R.subtract(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), every=True)
