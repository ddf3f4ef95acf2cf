"""String, date, math, array, map, JSON and generic scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from .registry import query


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS n, substr(p_name, 2, 4) AS part, trim('  ' || p_brand || ' ') AS trimmed, ltrim(p_brand, 'B') AS cut, replace(p_type, ' ', '_') AS swapped,
 reverse(p_brand) AS backwards, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, rpad(p_brand, 10, '.') AS dotted, strpos(p_name, 'a') AS at, left(p_name, 3) AS head, right(p_name, 3) AS tail, repeat(p_brand, 2) AS twice FROM part""")
def string_functions(t):
    c = F.col
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.lower("p_brand").alias("low"),
        F.length("p_name").cast("long").alias("n"),
        F.substring("p_name", 2, 4).alias("part"),
        F.trim(F.concat(F.lit("  "), c("p_brand"), F.lit(" "))).alias("trimmed"),
        F.ltrim(c("p_brand"), F.lit("B")).alias("cut"),
        F.replace(c("p_type"), F.lit(" "), F.lit("_")).alias("swapped"),
        F.reverse("p_brand").alias("backwards"),
        F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"),
        F.rpad("p_brand", 10, ".").alias("dotted"),
        F.instr("p_name", "a").cast("long").alias("at"),
        F.left(c("p_name"), F.lit(3)).alias("head"),
        F.right(c("p_name"), F.lit(3)).alias("tail"),
        F.repeat("p_brand", 2).alias("twice"),
    )


@query("""SELECT p_partkey, split_part(p_type, ' ', 1) AS first, concat_ws('|', p_brand, p_type) AS joined, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits,
 regexp_matches(p_name, 'e.*e') AS doubled, starts_with(p_brand, 'Brand#1') AS begins, ends_with(p_brand, '1') AS finishes, contains(p_name, 'ee') AS holds, translate(p_brand, 'abn', 'xyz') AS mapped, ascii(p_name) AS code, chr(65 + p_size % 26) AS letter FROM part""")
def string_patterns(t):
    c = F.col
    return t.part.select(
        "p_partkey",
        F.split_part(c("p_type"), F.lit(" "), F.lit(1)).alias("first"),
        F.concat_ws("|", "p_brand", "p_type").alias("joined"),
        F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"),
        c("p_name").rlike("e.*e").alias("doubled"),
        F.startswith(c("p_brand"), F.lit("Brand#1")).alias("begins"),
        F.endswith(c("p_brand"), F.lit("1")).alias("finishes"),
        F.contains(c("p_name"), F.lit("ee")).alias("holds"),
        F.translate("p_brand", "abn", "xyz").alias("mapped"),
        F.ascii("p_name").alias("code"),
        F.char(65 + c("p_size") % 26).alias("letter"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(o_orderdate) AS month_end,
 CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS later, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS season, strftime(o_orderdate, '%Y/%m/%d') AS said, hour(o_orderdate) AS h FROM orders""")
def date_functions(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.year(d).cast("long").alias("y"),
        F.month(d).cast("long").alias("m"),
        F.day(d).cast("long").alias("d"),
        F.quarter(d).cast("long").alias("q"),
        F.dayofyear(d).cast("long").alias("doy"),
        F.trunc(d, "month").alias("month_start"),
        F.last_day(d).alias("month_end"),
        F.date_add(d, 40).alias("later"),
        F.datediff(d, F.lit("1990-01-01")).cast("long").alias("days"),
        F.add_months(d, 3).alias("season"),
        F.date_format(d, "yyyy/MM/dd").alias("said"),
        F.hour(d).cast("long").alias("h"),
    )


@query("""SELECT s_suppkey, abs(s_acctbal) AS size, CAST(sign(s_acctbal) AS INTEGER) AS sgn, CAST(ceil(s_acctbal) AS BIGINT) AS up, CAST(floor(s_acctbal) AS BIGINT) AS down, round(s_acctbal, 1) AS near, round(sqrt(abs(s_acctbal)), 6) AS root, s_suppkey % 7 AS rest,
 round(ln(abs(s_acctbal) + 1), 6) AS natural, round(pow(s_suppkey, 2), 6) AS squared, round(exp(s_suppkey / 1000.0), 6) AS grown, greatest(s_suppkey, s_nationkey) AS hi, least(s_suppkey, s_nationkey) AS lo, s_suppkey & 5 AS bits, xor(s_suppkey, 5) AS flipped FROM supplier""")
def math_functions(t):
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    return t.supplier.select(
        "s_suppkey",
        F.abs(b).alias("size"),
        F.signum(b).cast("int").alias("sgn"),
        F.ceil(b).alias("up"),
        F.floor(b).alias("down"),
        F.round(b, 1).alias("near"),
        F.round(F.sqrt(F.abs(b)), 6).alias("root"),
        (k % 7).alias("rest"),
        F.round(F.ln(F.abs(b) + 1), 6).alias("natural"),
        F.round(F.pow(k, F.lit(2)), 6).alias("squared"),
        F.round(F.exp(k / 1000.0), 6).alias("grown"),
        F.greatest("s_suppkey", F.col("s_nationkey").cast("long")).alias("hi"),
        F.least("s_suppkey", F.col("s_nationkey").cast("long")).alias("lo"),
        k.bitwiseAND(F.lit(5)).alias("bits"),
        k.bitwiseXOR(F.lit(5)).alias("flipped"),
    )


@query("""SELECT a, b, CASE WHEN b <> 0 THEN a // b END AS whole, a % nullif(b, 0) AS rest FROM (VALUES (CAST(7 AS BIGINT), CAST(2 AS BIGINT)), (-7, 2), (7, -2), (-7, -2), (7, 0), (9007199254740993, 1), (9223372036854775807, 3), (NULL, 2)) AS x(a, b)""")
def integer_division(t):
    """Towards zero, exact over the whole range of BIGINT; null for zero."""
    v = R.values(t.spark, [(7, 2), (-7, 2), (7, -2), (-7, -2), (7, 0), (9007199254740993, 1), (9223372036854775807, 3), (None, 2)], "a long, b long")
    return v.select("a", "b", R.truncated_divide(F.col("a"), F.col("b")).alias("whole"), F.try_mod(F.col("a"), F.nullif(F.col("b"), F.lit(0))).alias("rest"))


@query("""SELECT o_custkey, len(list(o_orderkey)) AS n, list_aggregate(list(o_orderkey), 'min') AS lo, list_contains(list(o_orderstatus), 'F') AS has, list_sort(list(DISTINCT o_orderstatus))[1] AS first, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '') AS kinds,
 CAST(list_sum(list_filter(list(o_orderkey), lambda x: x % 2 = 0)) AS BIGINT) AS even FROM orders GROUP BY o_custkey""")
def array_functions(t):
    g = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"), F.collect_list("o_orderstatus").alias("states"))
    kinds, even = F.array_sort(F.array_distinct("states")), F.filter("keys", lambda x: x % 2 == 0)
    return g.select(
        "o_custkey",
        F.size("keys").cast("long").alias("n"),
        F.array_min("keys").alias("lo"),
        F.array_contains("states", "F").alias("has"),
        F.get(kinds, 0).alias("first"),
        F.array_join(kinds, "").alias("kinds"),
        F.when(F.size(even) > 0, F.aggregate(even, F.lit(0).cast("long"), lambda a, x: a + x)).alias("even"),
    )


@query("SELECT c_nationkey, unnest(list_sort(list(DISTINCT c_mktsegment))) AS segment FROM customer GROUP BY c_nationkey")
def array_explode(t):
    g = t.customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    return g.select("c_nationkey", F.explode("segments").alias("segment"))


@query("SELECT r_regionkey, count(*) AS n, min(n_nationkey) AS lo, max(n_nationkey) AS hi FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def map_functions(t):
    """A map of nations by name for each region, and what its functions say."""
    m = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    values = F.map_values("m")
    return m.filter(F.map_contains_key("m", F.element_at(F.map_keys("m"), 1))).select("r_regionkey", F.cardinality("m").cast("long").alias("n"), F.array_min(values).alias("lo"), F.array_max(values).alias("hi"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing, json_valid(props) AS valid FROM events")
def json_functions(t):
    p = F.col("props")
    return t.events.select("event_id", F.get_json_object(p, "$.k").cast("long").alias("k"), F.get_json_object(p, "$.none").alias("missing"), F.try_parse_json(p).isNotNull().alias("valid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_schema_read(t):
    """Text parsed by a given schema."""
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k")).filter("k > 50")


@query("SELECT n_nationkey, upper(n_name) AS a, coalesce(nullif(n_regionkey, 1), -1) AS b, greatest(n_nationkey, 7) AS c FROM nation")
def generic_call(t):
    """Functions called by name."""
    call = F.call_function
    return t.nation.select("n_nationkey", call("upper", F.col("n_name")).alias("a"), call("coalesce", call("nullif", F.col("n_regionkey"), F.lit(1)), F.lit(-1)).alias("b"), call("greatest", F.col("n_nationkey"), F.lit(7)).alias("c"))


@query("SELECT s, regexp_full_match(s, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') AS valid FROM (VALUES ('123e4567-e89b-12d3-a456-426614174000'), ('123E4567-E89B-12D3-A456-426614174000'), ('123e4567e89b12d3a456426614174000'), ('x'), (''), (NULL)) AS x(s)")
def uuid_validate(t):
    rows = [("123e4567-e89b-12d3-a456-426614174000",), ("123E4567-E89B-12D3-A456-426614174000",), ("123e4567e89b12d3a456426614174000",), ("x",), ("",), (None,)]
    return R.values(t.spark, rows, "s string").select("s", S.is_uuid(F.col("s")).alias("valid"))


@query("SELECT count(*) AS n, count(*) AS different, TRUE AS valid FROM customer")
def uuid_generate(t):
    """A new identifier a row: all valid, all different."""
    made = t.customer.select(F.uuid().alias("u"))
    return made.agg(F.count("u").alias("n"), F.count_distinct("u").alias("different"), F.bool_and(S.is_uuid(F.col("u"))).alias("valid"))
