"""SQL statements: prepared statements, DML and schema changes as transforms, subqueries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import types as Y
from ..plans import catalog as K
from ..plans import statements as S
from .registry import query
from .scans import _scratch


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 AND o_orderstatus <> '?'")
def prepared_point_lookup(t):
    t.orders.createOrReplaceTempView("millrace_orders")
    lookup = S.prepared(t.spark, "SELECT o_orderkey, o_totalprice FROM millrace_orders WHERE o_orderkey = ? AND o_orderstatus <> '?'")
    return lookup(7)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 25, 'ATLANTIS', 0 UNION ALL SELECT 26, 'LEMURIA', 4")
def dml_insert(t):
    rows = t.spark.createDataFrame([(25, "ATLANTIS", 0), (26, "LEMURIA", 4)], "n_nationkey int, n_name string, n_regionkey int")
    return S.insert(t.nation, rows)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 27, 'MU', 9")
def dml_insert_defaults(t):
    return S.insert(t.nation, t.spark.createDataFrame([(27, "MU")], "n_nationkey int, n_name string"), {"n_regionkey": 9})


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(t):
    new = {"c_acctbal": F.col("c_acctbal") + 100, "c_mktsegment": F.lit("X")}
    return S.update(t.customer, new, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 0, FALSE)")
def dml_delete(t):
    return S.delete(t.customer, F.col("c_acctbal") < 0)


@query("""SELECT coalesce(r.k, n.n_nationkey) AS n_nationkey, CASE WHEN r.k IS NOT NULL THEN r.name ELSE n.n_name END AS n_name, CASE WHEN r.k IS NOT NULL THEN r.region ELSE n.n_regionkey END AS n_regionkey
 FROM nation n FULL JOIN (VALUES (3, 'CANADA2', 1), (99, 'NEW', 2)) AS r(k, name, region) ON n.n_nationkey = r.k""")
def dml_upsert(t):
    rows = t.spark.createDataFrame([(3, "CANADA2", 1), (99, "NEW", 2)], "n_nationkey int, n_name string, n_regionkey int")
    return S.upsert(t.nation, rows, ["n_nationkey"])


@query("SELECT *, CAST(5 AS BIGINT) AS rating FROM region")
def schema_add_column(t):
    return S.add_column(t.region, "rating", "long", 5)


@query("SELECT r_regionkey AS id, r_name FROM region")
def schema_rename_column(t):
    return S.rename_column(t.region, "r_regionkey", "id")


@query("SELECT n_nationkey, n_name FROM nation")
def schema_drop_column(t):
    return S.drop_column(t.nation, "n_regionkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def row_level_filter(t):
    return S.row_level_filter(t.customer, "c_nationkey = 7").select("c_custkey", "c_nationkey")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON o_custkey = c_custkey WHERE total > 1000000")
def cte_query(t):
    return t.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM big JOIN {customer} ON o_custkey = c_custkey WHERE total > 1000000")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)")
def exists_subquery(t):
    return t.sql("SELECT s_suppkey FROM {supplier} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def in_subquery(t):
    return t.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'MACHINERY')")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_subquery(t):
    return t.sql("SELECT o_orderkey FROM {orders} o WHERE o_totalprice >= (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def staged_pipeline(t):
    """A statement that Spark parses, analyzes, optimizes and plans."""
    return t.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice > 1000 GROUP BY o_orderstatus")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 99, 'ATLANTIS'")
def create_insert_drop(t):
    """CREATE TABLE AS, INSERT and DROP TABLE in Spark's own catalog; the rows are read before the table goes."""
    name, path = f"millrace_t_{uuid.uuid4().hex}", _scratch(t)
    t.nation.createOrReplaceTempView("millrace_nation")
    t.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT n_nationkey, n_name FROM millrace_nation WHERE n_regionkey = 1")
    t.spark.sql(f"INSERT INTO {name} VALUES (99, 'ATLANTIS')")
    t.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return t.spark.read.schema("n_nationkey int, n_name string").parquet(path)


@query("SELECT * FROM (VALUES ('nation', 'nation_name', 'n_name', CAST(1 AS BIGINT))) AS x(table_name, index_name, column_name, ordinal_position)")
def create_drop_index(t):
    """Definitions: two tables, two indexes, one of each dropped again."""
    c = K.Catalog(t.spark)
    c.register("region", t.region)
    c.register("nation", t.nation)
    c.create_index("nation_name", "nation", ["n_name"])
    c.create_index("nation_region", "nation", ["n_regionkey"])
    c.drop_index("nation_region")
    c.drop_table("region")
    return c.sys_indexes()


@query("SELECT * FROM (VALUES ('sales', 'nation'), ('main', 'region')) AS x(database, table_name)")
def multi_database(t):
    """Databases created, used and dropped; each has its own tables."""
    c = K.Catalog(t.spark)
    c.register("region", t.region)
    c.create_database("sales")
    c.create_database("gone")
    c.drop_database("gone")
    c.use("sales")
    c.register("nation", t.nation)
    return t.spark.createDataFrame([(d, n) for d, tables in c.databases.items() for n in tables], "database string, table_name string")


@query("SELECT * FROM (VALUES ('+', 'int', 'bigint', 'bigint'), ('/', 'int', 'int', 'double'), ('=', 'text', 'text', 'boolean'), ('||', 'int', 'text', 'string'), ('AND', 'int', 'boolean', 'error'), ('+', 'date', 'int', 'error')) AS x(op, a, b, result)")
def type_check(t):
    """Result types of expressions, or an error, before anything runs."""
    rows = []
    for op, a, b in (("+", "int", "bigint"), ("/", "int", "int"), ("=", "text", "text"), ("||", "int", "text"), ("AND", "int", "boolean"), ("+", "date", "int")):
        try:
            rows.append((op, a, b, Y.binary_type(op, Y.parse_type(a), Y.parse_type(b)).simpleString()))
        except Y.TypeMismatch:
            rows.append((op, a, b, "error"))
    return t.spark.createDataFrame(rows, "op string, a string, b string, result string")
