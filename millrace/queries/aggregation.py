"""Aggregates and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import aggregates as A
from ..operators import relational as R
from .registry import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
def flagship(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("SELECT count(*) AS n, count(nullif(l_linenumber, 1)) AS some FROM lineitem")
def agg_count(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col("l_linenumber"), F.lit(1))).alias("some"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS whole, round(sum(l_quantity), 2) AS floating, CAST(sum(l_linenumber) FILTER (l_linenumber > 100) AS BIGINT) AS nothing FROM lineitem")
def agg_sum(t):
    n = F.col("l_linenumber")
    return t.lineitem.agg(F.sum(n).alias("whole"), F.round(F.sum("l_quantity"), 2).alias("floating"), F.sum(F.when(n > 100, n)).alias("nothing"))


@query("SELECT round(avg(l_quantity), 6) AS a, round(avg(nullif(l_linenumber, 1)), 6) AS b FROM lineitem")
def agg_avg(t):
    return A.aggregate(t.lineitem.withColumn("x", F.nullif(F.col("l_linenumber"), F.lit(1))), [], {"a": ("avg", "l_quantity"), "b": ("avg", "x")}).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("SELECT min(l_shipdate) AS first, max(l_shipdate) AS last, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_returnflag) AS flag FROM lineitem")
def agg_min_max(t):
    return A.aggregate(t.lineitem, [], {"first": ("min", "l_shipdate"), "last": ("max", "l_shipdate"), "lo": ("min", "l_extendedprice"), "hi": ("max", "l_extendedprice"), "flag": ("min", "l_returnflag")})


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def group_by_single(t):
    return A.aggregate(t.orders, ["o_orderstatus"], {"n": ("count", "*"), "total": ("sum", "o_totalprice")}).withColumn("total", F.round("total", 2))


@query("SELECT l_returnflag, x, count(*) AS n, max(l_quantity) AS hi FROM (SELECT *, nullif(l_linenumber, 1) AS x FROM lineitem) q GROUP BY l_returnflag, x")
def group_by_multi(t):
    """Null keys form a group."""
    return A.aggregate(t.lineitem.withColumn("x", F.nullif(F.col("l_linenumber"), F.lit(1))), ["l_returnflag", "x"], {"n": ("count", "*"), "hi": ("max", "l_quantity")})


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def agg_global(t):
    return A.aggregate(t.orders, [], {"n": ("count", "*"), "s": ("sum", "o_orderkey"), "a": ("avg", "o_totalprice"), "lo": ("min", "o_orderkey"), "hi": ("max", "o_orderkey")}).withColumn("a", F.round("a", 4))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590")
def group_by_having(t):
    return A.aggregate(t.lineitem, ["l_suppkey"], {"n": ("count", "*")}, F.col("n") > 590)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def agg_rollup(t):
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def agg_cube(t):
    return t.orders.cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def count_distinct(t):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query()
def approx_count_distinct(t):
    return S.approx_distinct(t.lineitem, "l_partkey")


@query()
def sketch_count_distinct(t):
    """Distinct parts a year from sketches of (year, flag)."""
    fine = S.distinct_sketches(t.lineitem.withColumn("year", F.year("l_shipdate")), ["year", "l_returnflag"], "l_partkey")
    return S.merge_sketches(fine, ["year"])


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def percentile_cont(t):
    return t.sql("SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM {lineitem} GROUP BY l_returnflag")


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_returnflag")
def percentile_disc(t):
    return t.sql("SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median FROM {lineitem} GROUP BY l_returnflag")


@query("SELECT l_quantity AS value, count(*) AS frequency FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def stats_mcv(t):
    return S.most_common(t.lineitem, "l_quantity")


@query("""SELECT bucket, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS frequency, count(DISTINCT o_totalprice) AS distinct_values FROM
 (SELECT o_totalprice, CAST((row_number() OVER (ORDER BY o_totalprice) - 1) // CAST(ceil(count(*) OVER () / 100.0) AS BIGINT) AS BIGINT) AS bucket FROM orders) q GROUP BY bucket""")
def stats_histogram_equi_depth(t):
    return S.equi_depth(t.orders, "o_totalprice")


@query("SELECT CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity >= 51 THEN 11 ELSE CAST(floor((l_quantity - 1) / 5) + 1 AS BIGINT) END AS bucket, count(*) AS frequency FROM lineitem GROUP BY 1")
def stats_histogram_equi_width(t):
    return S.equi_width(t.lineitem, "l_quantity", 1.0, 51.0, 10)


@query("""WITH v AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT v, n, v - lag(v) OVER (ORDER BY v) AS gap FROM v),
 c AS (SELECT v FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, v LIMIT 9), p AS (SELECT v, n, CAST(sum(CASE WHEN v IN (SELECT v FROM c) THEN 1 ELSE 0 END) OVER (ORDER BY v) AS BIGINT) AS bucket FROM g)
 SELECT bucket, min(v) AS lo, max(v) AS hi, CAST(sum(n) AS BIGINT) AS frequency, count(*) AS distinct_values FROM p GROUP BY bucket""")
def stats_histogram_max_diff(t):
    return S.max_diff(t.orders, "o_custkey", 10)


@query("""SELECT 'c_mktsegment' AS column, count(*) AS rows, count(*) - count(c_mktsegment) AS nulls, count(DISTINCT c_mktsegment) AS distinct_values, min(c_mktsegment) AS min_value, max(c_mktsegment) AS max_value, round(avg(length(c_mktsegment)), 4) AS avg_width FROM customer
 UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey), CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR), round(avg(length(CAST(c_nationkey AS VARCHAR))), 4) FROM customer""")
def stats_column_profile(t):
    return S.column_profile(t.customer, ["c_mktsegment", "c_nationkey"]).withColumn("avg_width", F.round("avg_width", 4))


@query("SELECT count(*) AS row_count, CAST(ceil(count(*) / 100.0) AS BIGINT) AS page_count FROM lineitem")
def stats_table_profile(t):
    return S.table_profile(t.lineitem)


@query()
def sample_reservoir(t):
    return R.sample(t.orders, 300, "o_orderkey", seed=1)


@query("SELECT 'l_quantity' AS left_column, 'l_extendedprice' AS right_column, round(corr(l_quantity, l_extendedprice) * 100, 4) AS correlation FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax) * 100, 4) FROM lineitem")
def stats_correlation(t):
    return S.correlation(t.lineitem, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]).withColumn("correlation", F.round("correlation", 4))


@query("SELECT 'o_orderstatus' AS column, round(1.0 / count(DISTINCT o_orderstatus), 6) AS selectivity FROM orders UNION ALL SELECT 'o_custkey', round(greatest(0.0001, 1.0 / count(DISTINCT o_custkey)), 6) FROM orders")
def stats_selectivity(t):
    return S.equality_selectivity(t.orders, ["o_orderstatus", "o_custkey"]).withColumn("selectivity", F.round("selectivity", 6))


@query("SELECT round(1.0 / greatest((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer)), 8) AS selectivity")
def stats_join_selectivity(t):
    return S.join_selectivity(t.orders, "o_custkey", t.customer, "c_custkey").select(F.round("selectivity", 8).alias("selectivity"))


@query("SELECT l_returnflag, count(l_quantity) AS count, round(sum(l_quantity), 2) AS sum, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag")
def distributed_partial_final_agg(t):
    """Partial states by shard, merged and finished."""
    states = A.salted(t.lineitem, ["l_returnflag"], "l_quantity")
    return A.finish(states).withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 6)})


@query("SELECT o_orderpriority, o_orderstatus, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS gid, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus), ())")
def agg_grouping_sets(t):
    keys = ("o_orderpriority", "o_orderstatus")
    grouped = t.orders.groupingSets([[F.col(keys[0])], [F.col(keys[1])], [F.col(k) for k in keys], []], *keys)
    return grouped.agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS large, round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS urgent FROM orders GROUP BY o_orderstatus")
def agg_filter(t):
    return t.sql("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS large, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent FROM {orders} GROUP BY o_orderstatus")


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string(t):
    return t.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")


@query("""WITH v AS (SELECT l_quantity AS v, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY l_quantity) AS k FROM lineitem GROUP BY 1),
 p AS (SELECT v, k, n, sum(n) OVER w AS s, sum(n * n) OVER w AS q FROM v WINDOW w AS (ORDER BY k)), z AS (SELECT k, s, q FROM p UNION ALL SELECT 0, 0, 0), m AS (SELECT max(k) AS top FROM v),
 e AS (SELECT a.k AS i, b.k AS j, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.k - a.k) AS err FROM z a JOIN z b ON a.k < b.k),
 c AS (SELECT x.j AS i, y.j AS j, x.err + y.err + w.err AS err FROM e x JOIN e y ON y.i = x.j JOIN e w ON w.i = y.j JOIN m ON w.j = top WHERE x.i = 0 ORDER BY err, x.j, y.j LIMIT 1)
 SELECT CAST(CASE WHEN p.k <= c.i THEN 0 WHEN p.k <= c.j THEN 1 ELSE 2 END AS BIGINT) AS bucket, min(v) AS lo, max(v) AS hi, CAST(sum(n) AS BIGINT) AS frequency, count(*) AS distinct_values FROM p, c GROUP BY 1""")
def stats_histogram_v_optimal(t):
    return S.v_optimal(t.lineitem, "l_quantity", 3)
