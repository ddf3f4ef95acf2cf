"""Every registered query of the library against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.queries import ENTRY, ORACLES, QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([[str(plain(r[k])) for k in order] for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert ENTRY in QUERIES


def test_sketches_are_near(spark, tables):
    from pyspark.sql import functions as F

    exact = tables.lineitem.agg(F.count_distinct("l_partkey").alias("d")).first()["d"]
    assert abs(QUERIES["approx_count_distinct"](spark, DATA).first()[0] - exact) <= 0.1 * exact


def test_without_sql(spark, tables):
    """What SQL cannot say of these queries."""
    import zlib

    run = lambda name: QUERIES[name](spark, DATA).collect()
    keys = {r["o_orderkey"] for r in tables.orders.select("o_orderkey").collect()}
    sample = [r["o_orderkey"] for r in run("sample_reservoir")]
    assert len(sample) == len(set(sample)) == min(300, len(keys)) and set(sample) <= keys and sample == [r["o_orderkey"] for r in run("sample_reservoir")]
    names = {r["c_custkey"]: r["c_name"] for r in tables.customer.collect()}
    assert {r["c_custkey"]: r["crc"] for r in run("hash_crc32")} == {k: zlib.crc32(n.encode()) for k, n in names.items()}
    shards = {r["shard"]: r["rows"] for r in run("shard_consistent_counts")}
    assert set(shards) == set(range(4)) and sum(shards.values()) == len(keys) and min(shards.values()) > len(keys) / 8
    exact = {r[0]: r[1] for r in tables.spark.sql(f"SELECT year(l_shipdate), count(DISTINCT l_partkey) FROM parquet.`{DATA}/lineitem.parquet` GROUP BY 1").collect()}
    assert all(abs(r["distinct_values"] - exact[r["year"]]) <= 0.1 * exact[r["year"]] for r in run("sketch_count_distinct"))


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
