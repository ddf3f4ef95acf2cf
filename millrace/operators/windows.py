"""Window functions with ROWS, RANGE and GROUPS frames and frame exclusion.

Spark has neither GROUPS frames nor EXCLUDE, holds all rows of a RANGE frame at once, and
starts anew at every row of a frame without an end. So peers are aggregated first, GROUPS
and RANGE frames run over one row a peer group, and a frame without an end is a frame
without a start in the opposite order. ROWS frames are dealt over ranges of rows, so no
task takes a whole partition. Exclusion splits the frame around what is excluded, so every
part is an ordinary frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNBOUNDED = None
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing
#: Rows of a range, about, and rows looked at to place the ends of ranges.
RANGE_ROWS, PROBES = 500_000, 4096


@dataclass
class Spec:
    """A window: partition columns, order (column, 'asc' | 'desc'), frame and exclusion.

    ``start`` and ``end`` count from the current row (negative: before); None is unbounded.
    """

    partition: list[str] = field(default_factory=list)
    order: list[tuple[str, str]] = field(default_factory=list)
    unit: str = "rows"
    start: int | None = UNBOUNDED
    end: int | None = 0
    exclude: str = "no others"

    def keys(self, backwards: bool = False) -> list[Column]:
        return [F.asc_nulls_first(c) if (d == "asc") != backwards else F.desc_nulls_last(c) for c, d in self.order]

    def bounds(self) -> tuple[int, int]:
        return FIRST if self.start is None else self.start, LAST if self.end is None else self.end

    def ordered(self):
        return Window.partitionBy(*self.partition).orderBy(*self.keys())

    def frame(self):
        lo = Window.unboundedPreceding if self.start is None else self.start
        hi = Window.unboundedFollowing if self.end is None else self.end
        w = self.ordered()
        return w.rowsBetween(lo, hi) if self.unit == "rows" else w.rangeBetween(lo, hi)


AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def ranking(name: str, spec: Spec, n: int = 1) -> Column:
    """row_number, rank, dense_rank, percent_rank, cume_dist, ntile(n), bucket_floor(n)."""
    w = spec.ordered()
    if name == "ntile":
        return F.ntile(n).over(w).cast("long")
    if name == "bucket_floor":  # floor((place - 1) * n / size) + 1
        size = F.count(F.lit(1)).over(Window.partitionBy(*spec.partition))
        return (F.floor((F.row_number().over(w) - 1) * n / size) + 1).cast("long")
    made = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}[name]().over(w)
    return made if name in ("percent_rank", "cume_dist") else made.cast("long")


def offset(name: str, column: str, spec: Spec, n: int = 1) -> Column:
    """lag and lead by n rows; null outside the partition."""
    return {"lag": F.lag, "lead": F.lead}[name](column, n).over(spec.ordered())


def positional(name: str, column: str, spec: Spec, n: int = 1) -> Column:
    """first_value, last_value and nth_value of the frame."""
    made = {"first_value": F.first, "last_value": F.last}.get(name)
    return (made(column) if made else F.nth_value(column, n)).over(spec.frame())


def _combine(name: str, values: list[tuple[Column, Column]]) -> Column:
    """One aggregate from (aggregate, count) pairs of disjoint parts of a frame."""
    if not values:
        return F.lit(0).cast("long") if name == "count" else F.lit(None)
    total = sum((F.coalesce(n, F.lit(0)) for _, n in values[1:]), F.coalesce(values[0][1], F.lit(0)))
    if name == "count":
        return total
    if len(values) == 1:
        return values[0][0] / F.nullif(total, F.lit(0)) if name == "avg" else values[0][0]
    if name in ("min", "max"):
        return (F.least if name == "min" else F.greatest)(*[v for v, _ in values])
    added = sum((F.coalesce(v, F.lit(0)) for v, _ in values[1:]), F.coalesce(values[0][0], F.lit(0)))
    return F.when(total > 0, added / total if name == "avg" else added)


def _inner(name: str) -> str:
    return "sum" if name == "avg" else name


def _around(lo: int, hi: int) -> list[tuple[int, int]]:
    """What of a frame is before the current row (or group) and behind it."""
    return [(a, b) for a, b in ((lo, min(hi, -1)), (max(lo, 1), hi)) if a <= b]


def _open(lo: int, hi: int) -> list[tuple[int, int]]:
    """A frame with one open end that reaches across the current row, cut there."""
    if lo == FIRST and 0 < hi < LAST:
        return [(FIRST, 0), (1, hi)]
    return [(lo, -1), (0, LAST)] if hi == LAST and FIRST < lo < 0 else [(lo, hi)]


def aggregate(df: DataFrame, name: str, column: str, spec: Spec, out: str) -> DataFrame:
    """``df`` with ``out``: sum, avg, min, max or count of a column over the frame (nulls skipped; empty: null, count 0).

    Exclusions: current row, group (with the row's peers) and ties (peers only). RANGE
    frames, which hold peers whole, take what is excluded off the frame's sum, count and
    avg; min and max cannot be taken back and raise ValueError. ROWS frames that exclude
    peers look at the values of a bounded side one by one (they cost its width a row); an
    unbounded side is a frame over peer groups.
    """
    return aggregates(df, {out: (name, column, spec)})


def aggregates(df: DataFrame, wanted: dict[str, tuple[str, str, Spec]]) -> DataFrame:
    """``df`` with several aggregates (output: name, column, spec) over frames of one unit, partition and order.

    ``df`` is read more than once, so it must give the same rows each time.
    """
    one, kinds = next(iter(wanted.values()))[2], df.select([AGGREGATES[n](c).alias(o) for o, (n, c, _) in wanted.items()]).schema
    if any((s.partition, s.order, s.unit) != (one.partition, one.order, one.unit) for _, _, s in wanted.values()):
        raise ValueError("aggregates of several windows")
    names, rows, others, groups, values = df.columns, _Asked("r"), _Asked("o"), _Asked("g"), {}
    for out, (name, column, spec) in wanted.items():
        (lo, hi), inner, exclude = spec.bounds(), _inner(name), spec.exclude
        own = F.when(F.col(column).isNotNull(), 1).otherwise(0).cast("long")
        itself = [(own if inner == "count" else F.col(column), own)] if lo <= 0 <= hi else []
        if spec.unit == "rows" and exclude in ("no others", "current row"):
            parts = [p for a, b in (_open(lo, hi) if exclude == "no others" else [x for y in _around(lo, hi) for x in _open(*y)]) for p in rows(column, inner, a, b)]
        elif spec.unit == "rows":
            parts = [p for a, b in ((FIRST, -1), (1, LAST)) if lo <= 0 <= hi and (lo if a == FIRST else hi) in (a, b) for p in groups(column, inner, a, b)]
            for k, (a, b) in enumerate(_around(lo, hi)):
                if not (lo <= 0 <= hi and (a == FIRST or b == LAST)):
                    df, made = _side(df, inner, column, spec, a, b, f"__side_{out}_{k}")
                    parts.append(made)
            parts += itself if exclude == "ties" else []
        elif spec.unit == "groups" or exclude == "no others":
            parts = [p for a, b in ([(lo, hi)] if exclude == "no others" else _around(lo, hi)) for p in groups(column, inner, a, b)]
            if exclude == "current row" and lo <= 0 <= hi:
                parts += [p for a, b in ((FIRST, -1), (1, LAST)) for p in others(column, inner, a, b)]
            parts += itself if exclude == "ties" else []
        elif name in ("min", "max"):
            raise ValueError(f"{name} over a RANGE frame with exclusion is not supported")
        else:
            [(v, n)] = groups(column, inner, lo, hi)
            zero, value = F.lit(0), F.coalesce(F.col(column), F.lit(0)) if inner == "sum" else own
            less, count = value, own
            if exclude != "current row":
                [(less, count)] = groups(column, inner, 0, 0, self_only=True)
                less = F.coalesce(less, zero)
            if exclude == "ties":
                less, count = less - value, count - own
            # the frame of a null is its peers, wherever the frame stands
            held = F.lit(True) if lo <= 0 <= hi else reduce(lambda x, y: x | y, [F.col(c).isNull() for c, _ in spec.order], F.lit(False))
            v, n = F.when(held, F.coalesce(v, zero) - less).otherwise(v), F.when(held, n - count).otherwise(n)
            parts = [(F.when(n > 0, v), n)]
        values[out] = _combine(name, parts).cast(kinds[out].dataType)
    if others:
        df = _dealt(df.withColumn("__n", F.monotonically_increasing_id()), Spec([*one.partition, *[c for c, _ in one.order]], [("__n", "asc")]), others, _salt(df, names))
    if rows:
        df = _dealt(df, one, rows, _range_of(df, one) if any((a, b) != (FIRST, LAST) for _, _, a, b in rows.asked) else None)
    if groups:
        df = _over_groups(df, one, groups)
    return df.withColumns(values).select(*[F.col(f"`{c}`") for c in names if c not in values], *values)


class _Asked:
    """Frames asked for at one level; each is answered by columns that the level adds."""

    def __init__(self, level: str):
        self.level, self.asked = level, {}

    def __bool__(self) -> bool:
        return bool(self.asked)

    def __call__(self, column: str, inner: str, lo: int, hi: int, self_only: bool = False) -> list[tuple[Column, Column]]:
        k = self.asked.setdefault((column, inner, lo, hi) if not self_only else (column, inner, None, None), len(self.asked))
        return [(F.col(f"__{self.level}{k}v"), F.col(f"__{self.level}{k}n"))]


def _frame(spec: Spec, lo: int, hi: int, unit: str = "rows"):
    """A frame of a window whose order has no peers; without an end: in the opposite order without a start."""
    base = Window.partitionBy(*spec.partition)
    if lo == FIRST and hi == LAST:
        return base
    w, (a, b) = (base.orderBy(*spec.keys(True)), (FIRST, -lo)) if hi == LAST else (base.orderBy(*spec.keys()), (lo, hi))
    return w.rowsBetween(a, b) if unit == "rows" else w.rangeBetween(a, b)


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def _over_groups(df: DataFrame, spec: Spec, asked: _Asked) -> DataFrame:
    """Frames over one row a peer group, joined to the rows: GROUPS frames, RANGE frames, and sides of ROWS frames that exclude peers."""
    keys = [*dict.fromkeys([*spec.partition, *[c for c, _ in spec.order]])]
    pairs = list(dict.fromkeys((c, inner) for c, inner, _, _ in asked.asked))
    held = {x: (f"__v{k}", f"__c{k}") for k, x in enumerate(pairs)}
    g = df.groupBy(*keys).agg(*[x for (c, inner), (v, n) in held.items() for x in (AGGREGATES[inner](c).alias(v), F.count(c).alias(n))])
    unit = "range" if spec.unit == "range" and any(x not in (None, 0, FIRST, LAST) for _, _, a, b in asked.asked for x in (a, b)) else "rows"
    cells = unit == "range" and isinstance(df.schema[spec.order[0][0]].dataType, T.IntegralType) and all(a is None or a != FIRST and b != LAST for _, _, a, b in asked.asked)
    if cells:
        g = _cells(g, spec, [(a, b) for _, _, a, b in asked.asked if a is not None])
        spec = Spec([*spec.partition, "__cell"], spec.order)
    made = {}
    for (c, inner, lo, hi), k in asked.asked.items():
        v, n = held[c, inner]
        merge, name = AGGREGATES["sum" if inner == "count" else inner], f"__{asked.level}{k}"
        alone = lo is None or unit == "rows" and lo == hi == 0
        made[f"{name}v"] = F.col(v) if alone else merge(v).over(_frame(spec, lo, hi, unit))
        made[f"{name}n"] = F.col(n) if alone else F.coalesce(F.sum(n).over(_frame(spec, lo, hi, unit)), F.lit(0))
    g = g.withColumns(made)
    g = g.filter("__own") if cells else g
    there = [f"__k{k}" for k in range(len(keys))]
    return df.join(g.select(*[F.col(c).alias(x) for c, x in zip(keys, there)], *made), _same(keys, there), "left").drop(*there)


def _cells(g: DataFrame, spec: Spec, frames: list[tuple[int, int]], least: int = 1) -> DataFrame:
    """Rows dealt over cells of an integral order key, those near the end of a cell also to its neighbour whose frames reach them."""
    (key, direction), = spec.order
    lo, hi = min(a for a, _ in frames), max(b for _, b in frames)
    lo, hi = (lo, hi) if direction == "asc" else (-hi, -lo)
    width, k = F.lit(max(8 * abs(lo), 8 * abs(hi), least)).cast("long"), F.col(key).cast("long")
    rest = F.pmod(k, width)
    home = F.call_function("div", k, width) - F.when((k < 0) & (rest != 0), 1).otherwise(0)
    home = F.coalesce(home, F.lit(0).cast("long"))
    near = F.array_compact(F.array(home, F.when(rest >= width + lo, home + 1), F.when(rest < hi, home - 1)))
    return g.withColumn("__home", home).withColumn("__cell", F.explode(near)).withColumn("__own", F.col("__cell") == F.col("__home"))


def _range_of(df: DataFrame, spec: Spec) -> Column | None:
    """The number of the range of a row by partition and order: ranges hold about RANGE_ROWS rows, whatever these are (None: one is enough).

    The ends of ranges are rows drawn at random, which come to the driver; they decide how
    evenly rows are dealt, never the result.
    """
    plain = (T.IntegralType, T.FractionalType, T.StringType, T.DateType, T.TimestampType, T.BooleanType)
    keys = [(c, d) for c, d in [*[(c, "asc") for c in spec.partition], *spec.order]]
    keys = list(takewhile(lambda x: isinstance(df.schema[x[0]].dataType, plain), keys))
    if not keys:
        return None
    seen = Observation()
    drawn = df.select(*[F.col(c).alias(f"k{k}") for k, (c, _) in enumerate(keys)]).observe(seen, F.count(F.lit(1)).alias("n"))
    order = Spec([], [(f"k{k}", d) for k, (_, d) in enumerate(keys)])
    found = drawn.orderBy(F.rand(7)).limit(PROBES).collect()
    many = min(seen.get["n"] // RANGE_ROWS, len(found))
    if not many:
        return None
    drawn = df.sparkSession.createDataFrame(found, drawn.schema).coalesce(1).orderBy(*order.keys()).collect()
    ends = list(dict.fromkeys(tuple(drawn[k * len(drawn) // (many + 1)]) for k in range(1, many + 1)))
    kinds = [df.schema[c].dataType for c, _ in keys]

    def place(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(_behind(keys, kinds, ends[mid]), place(mid + 1, b)).otherwise(place(a, mid))

    return place(0, len(ends))


def _behind(keys: list[tuple[str, str]], kinds: list, end: tuple) -> Column:
    """Whether a row comes after ``end`` in the order of the keys."""
    out = F.lit(False)
    for (c, d), kind, v in reversed(list(zip(keys, kinds, end))):
        x, y = F.col(c), F.lit(v).cast(kind)
        if d == "asc":
            after = x.isNotNull() if v is None else F.coalesce(x > y, F.lit(False))
        else:
            after = F.lit(False) if v is None else F.coalesce(x < y, F.lit(True))
        out = after | (x.eqNullSafe(y) & out)
    return out


def _salt(df: DataFrame, names: list[str]) -> Column | None:
    """Rows dealt by a hash of what they hold, about RANGE_ROWS rows of a group to a salt (None: one is enough)."""
    many = df.count() // RANGE_ROWS + 1
    hashed = [c for c in names if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*hashed), F.lit(many)) if many > 1 else None


def _dealt(df: DataFrame, spec: Spec, asked: _Asked, place: Column | None) -> DataFrame:
    """ROWS frames, dealt over places if there is one.

    Frames up to the current row or from it on add what other places hold from their
    totals. Bounded frames run in cells of row numbers, which overlap by the frames' width.
    Without a place, and for open frames that end elsewhere, a partition is one task's.
    """
    dealt = place is not None
    open_ = {x for x in asked.asked if dealt and (x[2] == FIRST and x[3] in (-1, 0) or x[3] == LAST and x[2] in (0, 1))}
    bounded = [x for x in asked.asked if dealt and x[2] != FIRST and x[3] != LAST]
    parts, totals = [*spec.partition, "__place"] if dealt else spec.partition, {}
    if dealt:
        df = df.withColumn("__place", place)
        pairs = {x: k for k, x in enumerate(dict.fromkeys((c, inner) for c, inner, _, _ in asked.asked if any((c, inner) == x[:2] for x in open_)))}
        t = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("__rows"), *[x for (c, inner), k in pairs.items() for x in (AGGREGATES[inner](c).alias(f"__v{k}"), F.count(c).alias(f"__c{k}"))])
        before, behind = (_frame(Spec(spec.partition, [("__place", "asc")]), a, b) for a, b in ((FIRST, -1), (1, LAST)))
        totals["__before"] = F.sum("__rows").over(before)
        for (c, inner), k in pairs.items():
            for end, w in ((0, before), (1, behind)):
                totals[f"__t{k}{end}v"] = AGGREGATES["sum" if inner == "count" else inner](f"__v{k}").over(w)
                totals[f"__t{k}{end}n"] = F.sum(f"__c{k}").over(w)
        there = [f"__k{k}" for k in range(len(parts))]
        t = t.withColumns(totals).select(*[F.col(c).alias(x) for c, x in zip(parts, there)], *totals)
        df = df.join(t, _same(parts, there), "left").drop(*there)
    here, made, late, last = Spec(parts, spec.order), {}, {}, {}
    if bounded or any(x[3] == LAST for x in asked.asked):
        made["__at"] = F.row_number().over(here.ordered())
    for x, k in asked.asked.items():
        c, inner, lo, hi = x
        back = hi == LAST and lo != FIRST and (x in open_ or not dealt)
        if x in bounded:
            w = _frame(Spec([*spec.partition, "__cell"], [("__rn", "asc")]), lo, hi)
        else:
            w = _frame(Spec(parts, [("__at", "asc")]) if back else here if x in open_ else spec, lo, hi)
        v, n = AGGREGATES[inner](c).over(w), F.count(c).over(w)
        if x in open_:
            t = f"__t{pairs[c, inner]}{int(hi == LAST)}"
            both = [(F.col(f"{t}v"), F.col(f"{t}n")), (v, n)]
            v, n = _combine(inner, both), _combine("count", both)
        (last if x in bounded else late if back else made).update({f"__{asked.level}{k}v": v, f"__{asked.level}{k}n": n})
    for step in (made, late):
        df = df.withColumns(step) if step else df
    if last:
        df = df.withColumn("__rn", F.col("__at") + F.coalesce("__before", F.lit(0)))
        df = _cells(df, Spec(spec.partition, [("__rn", "asc")]), [(a, b) for _, _, a, b in bounded], RANGE_ROWS).withColumns(last).filter("__own")
    return df.drop("__place", "__at", "__rn", "__home", "__cell", "__own", *totals)


def _side(df: DataFrame, inner: str, column: str, spec: Spec, lo: int, hi: int, at: str) -> tuple[DataFrame, tuple[Column, Column]]:
    """A bounded side of a ROWS frame without the row's peers."""
    peer = F.struct(*[F.col(c) for c, _ in spec.order])
    seen = F.filter(F.collect_list(F.struct(peer.alias("g"), F.col(column).alias("v"))).over(spec.ordered().rowsBetween(lo, hi)), lambda r: ~r["g"].eqNullSafe(peer) & r["v"].isNotNull())
    df = df.withColumn(at, F.transform(seen, lambda r: r["v"]))
    side, n = F.col(at), F.size(at).cast("long")
    kind = F.lit(0).cast("long") if isinstance(df.schema[column].dataType, T.IntegralType) else F.lit(0).cast("double")
    value = {"sum": F.when(n > 0, F.aggregate(side, kind, lambda t, v: t + v)), "min": F.array_min(side), "max": F.array_max(side), "count": n}[inner]
    return df, (value, n)
