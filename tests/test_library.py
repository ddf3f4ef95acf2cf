"""Library behaviour that no registered query shows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import types as Y
from millrace.operators import aggregates as A
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.plans import catalog as K
from millrace.plans import constraints as C
from millrace.plans import matviews as M
from millrace.plans import statements as S
from millrace.plans import versioned as V


def test_types():
    assert Y.parse_type("varchar(10)").simpleString() == "varchar(10)"
    assert Y.parse_type("DECIMAL(8, 2)").simpleString() == "decimal(8,2)"
    assert Y.common_type(Y.parse_type("SMALLINT"), Y.parse_type("BIGINT")).simpleString() == "bigint"
    assert Y.common_type(Y.parse_type("DECIMAL(8,2)"), Y.parse_type("INTEGER")).simpleString() == "decimal(12,2)"
    assert Y.common_type(Y.parse_type("DECIMAL(8,2)"), Y.parse_type("DOUBLE")).simpleString() == "double"
    assert Y.binary_type("/", Y.parse_type("INT"), Y.parse_type("INT")).simpleString() == "double"
    assert Y.aggregate_type("sum", Y.parse_type("DECIMAL(8,2)")).simpleString() == "decimal(18,2)"
    assert not Y.can_cast(Y.parse_type("DATE"), Y.parse_type("INT"))
    with pytest.raises(Y.TypeMismatch):
        Y.common_type(Y.parse_type("TEXT"), Y.parse_type("INT"))
    with pytest.raises(Y.TypeMismatch):
        Y.parse_type("BLOBBY")
    Y.define_type("money", "DECIMAL(12,2)")
    assert Y.parse_type("MONEY").simpleString() == "decimal(12,2)"


def test_literals(spark):
    row = spark.range(1).select(*[Y.infer_literal(x).alias(f"c{k}") for k, x in enumerate(["7", "7.5", "true", "NULL", "'abc'"])]).first()
    assert list(row) == [7, 7.5, True, None, "abc"]


def test_literals_that_are_text(spark):
    """Only digits are numbers; true and null are words."""
    row = spark.range(1).select(*[Y.infer_literal(x).alias(f"c{k}") for k, x in enumerate(["nan", "inf", "1_000", "-3", "1e3", ".5"])]).first()
    assert list(row) == ["nan", "inf", "1_000", -3, 1000.0, 0.5]


def test_prepared(spark):
    run = S.prepared(spark, "SELECT ? AS x, '?' AS y")
    assert list(run(3).first()) == [3, "?"] and run("x' OR 1=1 --").first()["x"] == "x' OR 1=1 --"


def test_stream_replays(spark, tmp_path):
    """A batch written twice changes nothing; a compacted table reads the same."""
    rows = [(1, 1, "a", "insert"), (2, 2, "b", "insert"), (1, 3, "c", "update"), (2, 4, None, "delete"), (3, 5, "x", "commit")]
    spark.createDataFrame(rows, "k long, v long, x string, op string").write.parquet(f"file://{tmp_path}/in")
    from millrace.streaming import streams as R

    changes = R.stream(spark, f"file://{tmp_path}/in", "k long, v long, x string, op string")
    for log in ("log", "again"):  # a new checkpoint replays the whole log into the same folders
        R.run_to_end(R.apply_changes(changes, f"file://{tmp_path}/out", ["k"], "v", "op", f"file://{tmp_path}/{log}"))
        assert [(r["k"], r["x"]) for r in R.current(spark, f"file://{tmp_path}/out", ["k"], "v", "op").collect()] == [(1, "c")]
    R.compact(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/small", ["k"], "v", "op")
    assert spark.read.parquet(f"file://{tmp_path}/small").count() == 1


def test_restrict(spark):
    parent, child = spark.createDataFrame([(1,), (2,)], "p long"), spark.createDataFrame([(1,), (None,)], "c long")
    with pytest.raises(C.Violation):
        C.delete_parents(parent, child, [("c", "p")], F.col("p") == 1, "restrict")
    assert C.delete_parents(parent, child, [("c", "p")], F.col("p") == 2, "no action")[0].count() == 1
    assert C.fk_violations(child, parent, [("c", "p")]).count() == 0
    assert C.duplicates(child, ["c"], primary=True).count() == 1 and C.duplicates(child, ["c"]).count() == 0


def test_views(spark, tmp_path):
    v = M.MaterializedViews(spark, f"file://{tmp_path}", most=1)
    v.create("a", lambda: spark.range(4), {"t"})
    with pytest.raises(ValueError):
        v.create("b", lambda: spark.range(4), {"t"})
    assert v.changed("t") == ["a"] and v.needs_refresh("a", 1e9) and v.read("a").count() == 4
    assert v.stats()["stale_reads"] == 1 and v.cleanup(0) == ["a"] and v.names() == []


def test_catalog(spark):
    c = K.Catalog(spark)
    c.create_table(K.TableDef("a", [("x", "int", False)], ["x"]))
    c.create_table(K.TableDef("b", [("y", "int", True)], foreign_keys=[("f", ["y"], "a", ["x"], "CASCADE", "CASCADE")]))
    with pytest.raises(ValueError):
        c.drop_table("a")
    c.create_index("i", "b", ["y"])
    assert c.sys_indexes().count() == 1 and c.schemata().count() == 1
    c.drop_index("i")
    c.create_database("other")
    c.use("other")
    assert not c.tables


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 9)), min_size=1, max_size=12))
def test_strategies_agree(spark, rows):
    a, b = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame(rows[::-1], "k long, w long")
    got = [sorted(map(tuple, J.join(a, b, [("k", "k")], how, s).select("v", "w").collect()), key=str) for how in ("inner", "left") for s in ("broadcast", "hash", "merge")]
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=15))
def test_partial_is_whole(spark, rows):
    df = spark.createDataFrame(rows, "k long, v long")
    parts = A.merge(A.partial(df, ["k"], "v"), ["k"])
    want = df.groupBy("k").agg(F.count("v").alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"))
    for got in (A.finish(parts), A.finish(A.salted(df, ["k"], "v"))):
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 1), st.integers(0, 3), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=14),
    st.sampled_from(["current row", "group", "ties"]),
    st.integers(-2, 0),
    st.integers(0, 2),
    st.sampled_from(["sum", "min", "max", "count", "avg"]),
)
def test_group_frames(spark, rows, exclude, start, end, name):
    """GROUPS frames with exclusion against a walk over the rows."""
    data = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i long, p long, o long, v long")
    got = {r["i"]: r["x"] for r in W.aggregate(df, name, "v", W.Spec(["p"], [("o", "asc")], "groups", start, end, exclude), "x").collect()}
    for i, p, o, v in data:
        mine = [r for r in data if r[1] == p]
        groups = sorted({r[2] for r in mine})
        g = groups.index(o)
        inside = [r for r in mine if start <= groups.index(r[2]) - g <= end]
        if exclude == "current row":
            inside = [r for r in inside if r[0] != i]
        else:
            inside = [r for r in inside if r[2] != o or exclude == "ties" and r[0] == i]
        vals = [r[3] for r in inside if r[3] is not None]
        want = len(vals) if name == "count" else None if not vals else {"sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[name](vals)
        assert got[i] == (pytest.approx(want) if isinstance(want, float) else want)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=14),
    st.sampled_from(["current row", "group", "ties"]),
    st.sampled_from([None, -2, 0, 1]),
    st.sampled_from([None, 2, 0, -1]),
    st.sampled_from(["sum", "count", "avg"]),
)
def test_range_frames(spark, rows, exclude, start, end, name):
    """RANGE frames with exclusion against a walk over the rows."""
    data = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i long, p long, o long, v long")
    if start is not None and end is not None and start > end:
        return
    got = {r["i"]: r["x"] for r in W.aggregate(df, name, "v", W.Spec(["p"], [("o", "asc")], "range", start, end, exclude), "x").collect()}
    for i, p, o, v in data:
        inside = [r for r in data if r[1] == p and (start is None or r[2] >= o + start) and (end is None or r[2] <= o + end)]
        inside = [r for r in inside if (r[0] != i if exclude == "current row" else r[2] != o or exclude == "ties" and r[0] == i)]
        vals = [r[3] for r in inside if r[3] is not None]
        want = len(vals) if name == "count" else None if not vals else sum(vals) if name == "sum" else sum(vals) / len(vals)
        assert got[i] == (pytest.approx(want) if isinstance(want, float) else want)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 1), st.integers(0, 3), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=14),
    st.sampled_from(["group", "ties"]),
    st.sampled_from([None, -2, 0]),
    st.sampled_from([None, 2, 0]),
    st.sampled_from(["sum", "min", "max", "count", "avg"]),
)
def test_row_frames_without_peers(spark, rows, exclude, start, end, name):
    """ROWS frames that exclude peers, bounded or not, against a walk over the rows."""
    data = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i long, p long, o long, v long")
    first = {}  # peers in any order: only frames that hold them whole, or none of them, have one answer
    for i, p, o, v in data:
        first.setdefault((p, o), []).append(i)
    if (start is not None or end is not None) and any(len(x) > 1 for x in first.values()):
        data = [r for r in data if first[r[1], r[2]][0] == r[0]]
        df = spark.createDataFrame(data, "i long, p long, o long, v long")
    got = {r["i"]: r["x"] for r in W.aggregate(df, name, "v", W.Spec(["p"], [("o", "asc")], "rows", start, end, exclude), "x").collect()}
    for i, p, o, v in data:
        mine = sorted((r for r in data if r[1] == p), key=lambda r: r[2])
        at = next(k for k, r in enumerate(mine) if r[0] == i)
        inside = [r for k, r in enumerate(mine) if (start is None or k >= at + start) and (end is None or k <= at + end)]
        inside = [r for r in inside if r[2] != o or exclude == "ties" and r[0] == i]
        vals = [r[3] for r in inside if r[3] is not None]
        want = len(vals) if name == "count" else None if not vals else {"sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[name](vals)
        assert got[i] == (pytest.approx(want) if isinstance(want, float) else want)


def frame_answer(mine, at, unit, start, end, exclude, name):
    """What a frame of the sorted rows (i, o, v) gives at one of them, by a walk."""
    o, groups = mine[at][1], sorted({r[1] for r in mine}, key=lambda x: (x is not None, x or 0))
    if unit == "groups":
        place = [groups.index(r[1]) for r in mine]
    elif unit == "range":  # nulls are peers of nulls only
        place = [float("-inf") if r[1] is None else r[1] for r in mine]
    else:
        place = list(range(len(mine)))
    inside = lambda k: place[k] == place[at] and (o is None and unit == "range" or (start or 0) <= 0 <= (end or 0)) or (start is None or place[k] - place[at] >= start) and (end is None or place[k] - place[at] <= end)
    out = [r for k, r in enumerate(mine) if inside(k) and (exclude == "no others" or exclude == "current row" and k != at or exclude in ("group", "ties") and (r[1] != o or exclude == "ties" and k == at))]
    vals = [r[2] for r in out if r[2] is not None]
    return len(vals) if name == "count" else None if not vals else {"sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[name](vals)


def check_frames(spark, unit, rows, frames, exclude, names=("sum", "min", "max", "count", "avg"), direction="asc"):
    df = spark.createDataFrame(rows, "i long, p long, o long, v long").repartition(3)
    spec = lambda start, end: W.Spec(["p"], [("o", direction)], unit, start, end, exclude)
    wanted = {f"x{k}_{n}": (n, "v", spec(*f)) for k, f in enumerate(frames) for n in names}
    got = {r["i"]: r for r in W.aggregates(df, wanted).collect()}
    assert len(got) == len(rows)
    turn = 1 if direction == "asc" else -1
    for p in {r[1] for r in rows}:
        mine = sorted(((i, o, v) for i, q, o, v in rows if q == p), key=lambda r: turn * (-1e9 if r[1] is None else r[1]))
        mine = [(i, o if o is None else turn * o, v) for i, o, v in mine]
        for at, (i, _, _) in enumerate(mine):
            for k, (start, end) in enumerate(frames):
                for n in names:
                    want = frame_answer(mine, at, unit, start, end, exclude, n)
                    assert got[i][f"x{k}_{n}"] == (pytest.approx(want) if isinstance(want, float) else want), (i, start, end, n)


def odd_rows(n, ties):
    import random

    rng = random.Random(5)
    keys = [rng.randrange(-40, 40) if ties else o for o in rng.sample(range(-2 * n, 2 * n), n)]
    return [(i, None if i % 17 == 0 else i % 3, o, None if i % 5 == 0 else rng.randrange(-9, 9)) for i, o in enumerate(keys)]


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("exclude", ["no others", "current row"])
def test_rows_over_ranges(spark, monkeypatch, direction, exclude):
    """ROWS frames of any shape, over many ranges, some of one row; one null in the order."""
    monkeypatch.setattr(W, "RANGE_ROWS", 7)
    rows = odd_rows(90, ties=False)
    rows[3] = (3, 0, None, 4)
    check_frames(spark, "rows", rows, [(None, -1), (None, 0), (0, None), (1, None), (None, 3), (-2, None), (None, -3), (3, None), (-2, 2), (9, 12), (-30, -1)], exclude, direction=direction)


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
def test_groups_over_ranges(spark, monkeypatch, exclude):
    """GROUPS frames whose groups are dealt over several places."""
    monkeypatch.setattr(W, "RANGE_ROWS", 7)
    rows = [(i, p, None if o is None else o // 20, v) for i, p, o, v in odd_rows(90, ties=True)]
    rows[3], rows[6] = (3, 0, None, 4), (6, 0, None, 2)
    check_frames(spark, "groups", rows, [(-1, 1), (None, 0), (0, None), (1, 2), (None, None)], exclude)


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
def test_range_over_cells(spark, exclude, direction):
    """RANGE frames over cells: negative keys and nulls, frames beside the current row."""
    rows = odd_rows(90, ties=True)
    if direction == "asc":
        rows[3], rows[6] = (3, 0, None, 4), (6, 0, None, 2)
    names = ("sum", "count", "avg") if exclude != "no others" else ("sum", "min", "max", "count", "avg")
    check_frames(spark, "range", rows, [(-3, 3), (0, 2), (2, 5), (-6, -1)], exclude, names, direction)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["win_exclude_current_groups", "win_frame_rows"])
def test_no_frame_begins_anew(spark, query):
    """A frame to the end of the partition is evaluated from the end; Spark would start again at each row."""
    from millrace.queries import QUERIES

    from .conftest import DATA

    assert "currentrow$(), unboundedfollowing$()" not in plan_of(QUERIES[query](spark, DATA))
    assert "1, unboundedfollowing$()" not in plan_of(QUERIES[query](spark, DATA))


@pytest.mark.parametrize("query", ["win_exclude_group", "win_exclude_ties", "win_exclude_range", "win_frame_groups"])
def test_frames_hold_groups_not_rows(spark, query):
    """Every window of these runs over rows that were aggregated to one a peer group."""
    from millrace.queries import QUERIES

    from .conftest import DATA

    lines = plan_of(QUERIES[query](spark, DATA)).split("\n")
    at = [k for k, x in enumerate(lines) if "Window [" in x]
    assert at and all(any("Aggregate [" in y for y in lines[k:]) for k in at)


def test_buckets_follow_rows(spark, monkeypatch):
    """The number of buckets grows with the rows, each bucket is one file, and the join needs no exchange."""
    from millrace.queries import QUERIES
    from millrace.sources import files

    from .conftest import DATA

    monkeypatch.setattr(files, "BUCKET_ROWS", 700, raising=False)
    want = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 700)
    df = QUERIES["bucketed_join"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count(f"SelectedBucketsCount: {want} out of {want}") == 2 and want > 4
    assert len(df.inputFiles()) <= 2 * want


def test_v_optimal(spark):
    """The least squared error of all ways to cut."""
    from itertools import combinations

    from millrace.functions import stats as Z

    n = [3, 3, 9, 8, 1, 1, 2, 7]
    df = spark.createDataFrame([(v,) for v, k in enumerate(n) for _ in range(k)], "v long")

    def error(cuts):
        parts = [n[a:b] for a, b in zip((0, *cuts), (*cuts, len(n)))]
        return sum(sum((x - sum(p) / len(p)) ** 2 for x in p) for p in parts)

    want = min(combinations(range(1, len(n)), 2), key=error)
    got = Z.v_optimal(df, "v", 3).orderBy("bucket").collect()
    assert [r["lo"] for r in got] == [0, *want] and sum(r["frequency"] for r in got) == sum(n)
    coarse = Z.v_optimal(df, "v", 3, cells=4).collect()
    assert sum(r["frequency"] for r in coarse) == sum(n) and Z.v_optimal(df.limit(0), "v", 3).count() == 0


def test_as_of_ties(spark):
    a = spark.createDataFrame([(1, 5, "x"), (1, 0, "early"), (None, 5, "null"), (2, 5, "none")], "k long, at long, x string")
    b = spark.createDataFrame([(1, 5, 7), (1, 5, 9), (1, 3, 1), (1, 6, 2)], "k long, at long, y long")
    got = {r["x"]: r["y"] for r in J.as_of_join(a, b, ["k"], "at", ["y"]).collect()}
    assert got == {"x": 9, "early": None, "null": None, "none": None}
