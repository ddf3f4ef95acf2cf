"""Window functions. Every window has a total order, or an output that ties cannot change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .registry import query

ORDER = [("o_totalprice", "asc"), ("o_orderkey", "asc")]
TIES = [("o_orderpriority", "asc")]
BY = ["o_orderstatus"]
OVER = "PARTITION BY o_orderstatus ORDER BY o_totalprice NULLS FIRST, o_orderkey"
TIED = "PARTITION BY o_orderstatus ORDER BY o_orderpriority NULLS FIRST"


def spec(**how) -> W.Spec:
    return W.Spec(BY, how.pop("order", ORDER), **how)


def _agg(name: str, expr: str, frame: str, over: str = OVER) -> str:
    return f"SELECT o_orderkey, {expr} AS v FROM (SELECT o_orderkey, {name} OVER ({over} {frame}) AS a FROM orders) q"


@query(_agg("sum(o_totalprice)", "round(a, 2)", "ROWS UNBOUNDED PRECEDING"))
def win_running_sum(t):
    return W.aggregate(t.orders, "sum", "o_totalprice", spec(), "v").select("o_orderkey", F.round("v", 2).alias("v"))


@query(_agg("avg(o_totalprice)", "round(a, 4)", "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"))
def win_moving_avg(t):
    return W.aggregate(t.orders, "avg", "o_totalprice", spec(start=-3, end=3), "v").select("o_orderkey", F.round("v", 4).alias("v"))


@query(_agg("count(*)", "a", "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"))
def win_count(t):
    return W.aggregate(t.orders, "count", "o_orderkey", spec(start=-5, end=0), "v").select("o_orderkey", "v")


@query(f"SELECT o_orderkey, min(o_custkey) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lo, max(o_custkey) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS hi FROM orders WINDOW w AS ({OVER})")
def win_min_max(t):
    return W.aggregates(t.orders, {"lo": ("min", "o_custkey", spec(start=-4, end=-1)), "hi": ("max", "o_custkey", spec(start=1, end=4))}).select("o_orderkey", "lo", "hi")


def _rank(name: str, order=None, n: int = 1):
    def run(t):
        return t.orders.select("o_orderkey", W.ranking(name, spec(order=order or ORDER), n).alias("v"))

    return run


@query(f"SELECT o_orderkey, row_number() OVER ({OVER}) AS v FROM orders")
def win_row_number(t):
    return _rank("row_number")(t)


@query(f"SELECT o_orderkey, rank() OVER ({TIED}) AS v FROM orders")
def win_rank(t):
    return _rank("rank", TIES)(t)


@query(f"SELECT o_orderkey, dense_rank() OVER ({TIED}) AS v FROM orders")
def win_dense_rank(t):
    return _rank("dense_rank", TIES)(t)


@query(f"SELECT o_orderkey, round(percent_rank() OVER ({TIED}), 8) AS v FROM orders")
def win_percent_rank(t):
    return _rank("percent_rank", TIES)(t).withColumn("v", F.round("v", 8))


@query(f"SELECT o_orderkey, round(cume_dist() OVER ({TIED}), 8) AS v FROM orders")
def win_cume_dist(t):
    return _rank("cume_dist", TIES)(t).withColumn("v", F.round("v", 8))


@query(f"SELECT o_orderkey, ntile(4) OVER ({OVER}) AS v FROM orders")
def win_ntile(t):
    return _rank("ntile", n=4)(t)


@query(f"SELECT o_orderkey, CAST(((row_number() OVER ({OVER}) - 1) * 4) // count(*) OVER (PARTITION BY o_orderstatus) + 1 AS BIGINT) AS v FROM orders")
def win_bucket_floor(t):
    return _rank("bucket_floor", n=4)(t)


@query(f"SELECT o_orderkey, lag(o_custkey, 2) OVER ({OVER}) AS v FROM orders")
def win_lag(t):
    return t.orders.select("o_orderkey", W.offset("lag", "o_custkey", spec(), 2).alias("v"))


@query(f"SELECT o_orderkey, lead(o_custkey, 2) OVER ({OVER}) AS v FROM orders")
def win_lead(t):
    return t.orders.select("o_orderkey", W.offset("lead", "o_custkey", spec(), 2).alias("v"))


@query(f"SELECT o_orderkey, first_value(o_custkey) OVER ({OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM orders")
def win_first_value(t):
    return t.orders.select("o_orderkey", W.positional("first_value", "o_custkey", spec(start=-2)).alias("v"))


@query(f"SELECT o_orderkey, last_value(o_custkey) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM orders")
def win_last_value(t):
    return t.orders.select("o_orderkey", W.positional("last_value", "o_custkey", spec(start=0, end=2)).alias("v"))


@query(f"SELECT o_orderkey, nth_value(o_custkey, 3) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS v FROM orders")
def win_nth_value(t):
    return t.orders.select("o_orderkey", W.positional("nth_value", "o_custkey", spec(), 3).alias("v"))


@query(f"""SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS a, round(sum(o_totalprice) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS b,
 count(*) OVER (w ROWS BETWEEN 9 FOLLOWING AND 12 FOLLOWING) AS c FROM orders WINDOW w AS ({OVER})""")
def win_frame_rows(t):
    """Frames beyond the partition are empty: sum null, count 0."""
    wanted = {"a": ("sum", "o_totalprice", spec(end=-1)), "b": ("sum", "o_totalprice", spec(start=0, end=None)), "c": ("count", "o_orderkey", spec(start=9, end=12))}
    return W.aggregates(t.orders, wanted).select("o_orderkey", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "c")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS v FROM orders")
def win_frame_range(t):
    return W.aggregate(t.orders, "count", "o_orderkey", spec(order=[("o_orderkey", "asc")], unit="range", start=-100, end=100), "v").select("o_orderkey", "v")


@query(_agg("sum(o_custkey)", "CAST(a AS BIGINT)", "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING", TIED))
def win_frame_groups(t):
    return W.aggregate(t.orders, "sum", "o_custkey", spec(order=TIES, unit="groups", start=-1, end=1), "v").select("o_orderkey", "v")


@query(f"""SELECT o_orderkey, CAST(sum(o_custkey) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s, max(o_custkey) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m,
 count(o_custkey) OVER (w ROWS BETWEEN CURRENT ROW AND CURRENT ROW EXCLUDE CURRENT ROW) AS c FROM orders WINDOW w AS ({OVER})""")
def win_exclude_current(t):
    both = dict(start=-2, end=2, exclude="current row")
    wanted = {"s": ("sum", "o_custkey", spec(**both)), "m": ("max", "o_custkey", spec(**both)), "c": ("count", "o_custkey", spec(start=0, end=0, exclude="current row"))}
    return W.aggregates(t.orders, wanted).select("o_orderkey", "s", "m", "c")


@query(f"SELECT o_orderkey, CAST(sum(x) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s, min(x) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM (SELECT *, nullif(o_custkey, 1) AS x FROM orders) q WINDOW w AS ({TIED})")
def win_exclude_current_groups(t):
    both = dict(order=TIES, unit="groups", start=-1, end=1, exclude="current row")
    df = t.orders.withColumn("x", F.nullif(F.col("o_custkey"), F.lit(1)))
    return W.aggregates(df, {"s": ("sum", "x", spec(**both)), "m": ("min", "x", spec(**both))}).select("o_orderkey", "s", "m")


@query(f"SELECT o_orderkey, CAST(sum(o_custkey) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS s, round(avg(o_custkey) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP), 4) AS a FROM orders WINDOW w AS ({TIED})")
def win_exclude_group(t):
    both = dict(order=TIES, unit="groups", start=-1, end=1, exclude="group")
    return W.aggregates(t.orders, {"s": ("sum", "o_custkey", spec(**both)), "a": ("avg", "o_custkey", spec(**both))}).select("o_orderkey", "s", F.round("a", 4).alias("a"))


@query(f"SELECT o_orderkey, CAST(sum(o_custkey) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS BIGINT) AS s, max(o_custkey) OVER (w GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES) AS m FROM orders WINDOW w AS ({TIED})")
def win_exclude_ties(t):
    how = lambda end: spec(order=TIES, unit="groups", start=-1, end=end, exclude="ties")
    return W.aggregates(t.orders, {"s": ("sum", "o_custkey", how(1)), "m": ("max", "o_custkey", how(0))}).select("o_orderkey", "s", "m")


@query("SELECT n_nationkey, min(n_nationkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS g, max(n_nationkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS s FROM nation WINDOW w AS (ORDER BY n_regionkey NULLS FIRST)")
def win_exclude_peers_rows(t):
    how = dict(start=None, end=None)
    df = W.aggregate(t.nation, "min", "n_nationkey", W.Spec([], [("n_regionkey", "asc")], exclude="group", **how), "g")
    return W.aggregate(df, "max", "n_nationkey", W.Spec([], [("n_regionkey", "asc")], exclude="ties", **how), "s").select("n_nationkey", "g", "s")


@query("""SELECT o_orderkey, count(o_custkey) OVER (w RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING EXCLUDE CURRENT ROW) AS c, CAST(sum(o_orderkey) OVER (w RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS g,
 round(avg(o_orderkey) OVER (w RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING EXCLUDE TIES), 4) AS s FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_custkey)""")
def win_exclude_range(t):
    how = lambda exclude, start=-50: spec(order=[("o_custkey", "asc")], unit="range", start=start, end=50, exclude=exclude)
    wanted = {"c": ("count", "o_custkey", how("current row")), "g": ("sum", "o_orderkey", how("group")), "s": ("avg", "o_orderkey", how("ties", 0))}
    return W.aggregates(t.orders, wanted).select("o_orderkey", "c", "g", F.round("s", 4).alias("s"))


@query("""SELECT n_nationkey, CAST(sum(n_nationkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS BIGINT) AS s, round(avg(n_nationkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES), 4) AS a,
 count(n_nationkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS c FROM nation WINDOW w AS (ORDER BY n_regionkey NULLS FIRST)""")
def win_exclude_peers_unbounded(t):
    how = lambda exclude, end=None: W.Spec([], [("n_regionkey", "asc")], start=None, end=end, exclude=exclude)
    df = W.aggregate(t.nation, "sum", "n_nationkey", how("group"), "s")
    df = W.aggregate(df, "avg", "n_nationkey", how("ties"), "a")
    return W.aggregate(df, "count", "n_nationkey", how("group", 0), "c").select("n_nationkey", "s", F.round("a", 4).alias("a"), "c")
