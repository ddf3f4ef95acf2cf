"""Projection, filter, predicates, scalar expressions and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from .registry import query


@query("SELECT o_orderkey, o_custkey FROM orders")
def project_columns(t):
    return t.orders.select("o_orderkey", "o_custkey")


@query("SELECT p_name, p_partkey, p_size FROM part")
def project_by_ordinal(t):
    return R.project_ordinals(t.part, [1, 0, 4])


@query("SELECT o_orderkey AS k, o_totalprice * 2 AS double_price FROM orders")
def project_alias(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("double_price"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(t):
    return t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_size % 7 = 3")
def filter_udf(t):
    """A closure as predicate, as a vectorised function."""

    @F.pandas_udf("boolean")
    def keep(size):
        return size % 7 == 3

    return t.part.filter(keep("p_size")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '1-URGENT')")
def filter_and_or_not(t):
    return t.orders.filter(((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 200000)) & ~(F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("""SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part""")
def filter_comparisons(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", (s == 10).alias("eq"), (s != 10).alias("ne"), (s < 10).alias("lt"), (s <= 10).alias("le"), (s > 10).alias("gt"), (s >= 10).alias("ge"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00_1%'")
def filter_like(t):
    return t.customer.filter(F.col("c_name").like("%00_1%")).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'CUSTOMER%7'")
def filter_ilike(t):
    return t.customer.filter(S.case_insensitive_like(F.col("c_name"), "CUSTOMER%7")).select("c_custkey", "c_name")


@query("SELECT count(*) AS n, count(*) FILTER (x IS NULL) AS nulls, count(*) FILTER (x IS NOT NULL) AS not_nulls FROM (SELECT nullif(l_linenumber, 1) AS x FROM lineitem)")
def filter_is_null(t):
    x = F.nullif(F.col("l_linenumber"), F.lit(1))
    return t.lineitem.select(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.count_if(F.col("x").isNotNull()).alias("not_nulls"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 7)")
def filter_in_list(t):
    return t.nation.filter(F.col("n_nationkey").isin(1, 3, 5, 7)).select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def filter_between(t):
    return t.orders.filter(F.col("o_totalprice").between(100000, 150000)).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity + 1 AS plus, l_quantity - 1 AS minus, l_quantity * 2 AS times,
 l_extendedprice / l_quantity AS ratio, CAST(l_orderkey // 7 AS BIGINT) AS whole FROM lineitem""")
def project_arithmetic(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", (q + 1).alias("plus"), (q - 1).alias("minus"), (q * 2).alias("times"), (F.col("l_extendedprice") / q).alias("ratio"), R.truncated_divide(F.col("l_orderkey"), F.lit(7)).alias("whole"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_retailprice / (p_size % 5), 4) END AS q FROM part")
def safe_divide(t):
    return t.part.select("p_partkey", F.round(R.safe_divide(F.col("p_retailprice"), F.col("p_size") % 5), 4).alias("q"))


@query("SELECT c_custkey, -c_acctbal AS negated FROM customer")
def project_negate(t):
    return t.customer.select("c_custkey", (-F.col("c_acctbal")).alias("negated"))


@query("SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS label FROM nation")
def string_concat(t):
    return t.nation.select("n_nationkey", F.concat("n_name", F.lit("-"), F.col("n_regionkey").cast("string")).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
def case_when(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
def case_simple(t):
    return t.sql("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM {orders}")


@query("""SELECT p_partkey, CAST(p_size AS BIGINT) AS wide, CAST(p_size AS DOUBLE) AS floating, CAST(p_partkey AS VARCHAR) AS text,
 TRY_CAST(p_brand AS INTEGER) AS bad, CAST(p_size > 10 AS INTEGER) AS flag FROM part""")
def cast_types(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", s.cast("long").alias("wide"), s.cast("double").alias("floating"), F.col("p_partkey").cast("string").alias("text"), F.col("p_brand").try_cast("int").alias("bad"), (s > 10).cast("int").alias("flag"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber + l_orderkey AS int_long, l_linenumber + l_quantity AS int_double, l_linenumber / 2 AS ratio FROM lineitem")
def numeric_promotion(t):
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", (n + F.col("l_orderkey")).alias("int_long"), (n + F.col("l_quantity")).alias("int_double"), (n / 2).alias("ratio"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.0 END, 0.0) AS v FROM orders")
def coalesce_fn(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.coalesce(F.when(k % 3 != 0, F.col("o_totalprice")), F.when(k % 2 != 0, F.lit(1.0)), F.lit(0.0)).alias("v"))


@query("""SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS neither, (a AND b) IS NULL AS unknown
 FROM (VALUES (TRUE), (FALSE), (NULL)) AS x(a), (VALUES (TRUE), (FALSE), (NULL)) AS y(b)""")
def three_valued_logic(t):
    v = R.values(t.spark, [(True,), (False,), (None,)], "a boolean")
    a, b = F.col("a"), F.col("b")
    return v.crossJoin(v.withColumnRenamed("a", "b")).select("a", "b", (a & b).alias("both"), (a | b).alias("either"), (~a).alias("neither"), (a & b).isNull().alias("unknown"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(t):
    return t.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def hash_sha256(t):
    return t.customer.select("c_custkey", S.sha256_hex(F.col("c_name")).alias("digest"))


@query()
def hash_crc32(t):
    return t.customer.select("c_custkey", S.checksum(F.col("c_name")).alias("crc"), S.xxhash(F.col("c_name")).alias("xx"))


@query("SELECT n_nationkey, lower(hex(n_name)) AS hexed FROM nation")
def hex_encode(t):
    return t.nation.select("n_nationkey", S.hex_lower(F.col("n_name")).alias("hexed"))


@query("SELECT n_nationkey, base64(encode(n_name)) AS encoded FROM nation")
def base64_encode(t):
    return t.nation.select("n_nationkey", S.base64_text(F.col("n_name")).alias("encoded"))


@query("SELECT n, round(pow(1 - exp(-3.0 * n / 1000), 3), 9) AS rate FROM (SELECT unnest(generate_series(0, 1000, 50)) AS n)")
def bloom_fpr_formula(t):
    n = t.spark.range(0, 1001, 50).select(F.col("id").alias("n"))
    return n.select("n", F.round(S.bloom_false_rate(F.col("n"), F.lit(1000.0), 3), 9).alias("rate"))


@query("SELECT event_id, (((epoch_us(ts) // 1000) << 16) | (event_id & 65535)) AS clock, epoch_us(ts) // 1000 AS millis, event_id & 65535 AS counter FROM events")
def clock_pack(t):
    clock = S.clock_pack(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id"))
    return t.events.select("event_id", clock.alias("clock"), S.clock_millis(clock).alias("millis"), S.clock_counter(clock).alias("counter"))
