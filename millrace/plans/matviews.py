"""Materialized views: creation, staleness, full and incremental refresh."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass
class AggregateView:
    """A grouped view kept as mergeable partial results. measures: name -> (count | sum | avg | min | max, column)."""

    keys: list[str]
    measures: dict[str, tuple[str, str]]

    def steps(self) -> list[tuple[str, str, str]]:
        out = []
        for n, (f, c) in self.measures.items():
            out += [(f"{n}__s", "sum", c), (f"{n}__n", "count", c)] if f == "avg" else [(n, f, c)]
        return out

    def partial(self, base: DataFrame) -> DataFrame:
        made = {"count": lambda c: F.count(F.lit(1) if c == "*" else F.col(c)), "sum": F.sum, "min": F.min, "max": F.max}
        return base.groupBy(*self.keys).agg(*[made[f](c).alias(n) for n, f, c in self.steps()])

    def merge(self, *states: DataFrame) -> DataFrame:
        both = states[0]
        for s in states[1:]:
            both = both.unionByName(s)
        return both.groupBy(*self.keys).agg(*[MERGE[f](n).alias(n) for n, f, _ in self.steps()])

    def finish(self, state: DataFrame) -> DataFrame:
        return state.select(*self.keys, *[F.try_divide(F.col(f"{n}__s"), F.col(f"{n}__n")).alias(n) if f == "avg" else F.col(n) for n, (f, _) in self.measures.items()])


@dataclass
class View:
    name: str
    query: Callable[[], DataFrame] | AggregateView
    bases: set[str]
    base: Callable[[], DataFrame] | None = None
    dirty: bool = False
    refreshed: float = 0.0
    stale_reads: int = 0
    refreshes: int = 0
    generation: int = field(default=0)


class MaterializedViews:
    """Views kept as Parquet under ``path``; each refresh writes a new folder, then points to it."""

    def __init__(self, spark: SparkSession, path: str, most: int = 1000):
        self.spark, self.path, self.most, self.views = spark, path.rstrip("/"), most, {}

    def create(self, name: str, query, bases: set[str], base: Callable[[], DataFrame] | None = None) -> View:
        """``query``: a function that gives the view's frame, or an AggregateView over ``base``."""
        if name in self.views:
            raise ValueError(f"view {name} exists")
        if len(self.views) >= self.most:
            raise ValueError("too many views")
        self.views[name] = View(name, query, set(bases), base, dirty=True)
        self.refresh(name)
        return self.views[name]

    def drop(self, name: str) -> None:
        del self.views[name]

    def names(self) -> list[str]:
        return sorted(self.views)

    def changed(self, table: str) -> list[str]:
        """Mark the views on a base table as stale; gives their names."""
        hit = [v for v in self.views.values() if table in v.bases]
        for v in hit:
            v.dirty = True
        return sorted(v.name for v in hit)

    def _write(self, view: View, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{view.name}/{view.generation + 1}")
        view.generation += 1
        view.dirty, view.refreshed, view.refreshes = False, time.time(), view.refreshes + 1

    def _stored(self, view: View) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{view.name}/{view.generation}")

    def read(self, name: str) -> DataFrame:
        """What the last refresh stored, stale or not."""
        view = self.views[name]
        view.stale_reads += view.dirty
        stored = self._stored(view)
        return view.query.finish(stored) if isinstance(view.query, AggregateView) else stored

    def refresh(self, name: str) -> bool:
        """Compute the view anew if it is stale."""
        view = self.views[name]
        if view.dirty:
            self._write(view, view.query.partial(view.base()) if isinstance(view.query, AggregateView) else view.query())
        return bool(view.refreshes)

    def refresh_with(self, name: str, delta: DataFrame) -> None:
        """Add inserted base rows: a select-project view gets ``delta`` (its own rows), an aggregate view merges their partials."""
        view = self.views[name]
        stored = self._stored(view)
        if isinstance(view.query, AggregateView):
            self._write(view, view.query.merge(stored, view.query.partial(delta)))
        else:
            self._write(view, stored.unionByName(delta))

    def refresh_without(self, name: str, removed: DataFrame, inserted: DataFrame | None = None) -> None:
        """Take deleted base rows off an aggregate view of counts, sums and averages (an update deletes the old row and inserts the new).

        A view that counts its rows ("*") loses groups of which none is left. Minima and maxima cannot be taken back: such a view is refreshed in full.
        """
        view = self.views[name]
        if not isinstance(view.query, AggregateView) or any(f in ("min", "max") for _, f, _ in view.query.steps()):
            view.dirty = True
            self.refresh(name)
            return
        less = view.query.partial(removed)
        less = less.select(*view.query.keys, *[(-F.col(n)).alias(n) for n, _, _ in view.query.steps()])
        states = [self._stored(view), less] + ([view.query.partial(inserted)] if inserted is not None else [])
        left = view.query.merge(*states)
        counts = [n for n, f, c in view.query.steps() if f == "count" and c == "*"]
        self._write(view, left.filter(F.col(counts[0]) > 0) if counts else left)

    def needs_refresh(self, name: str, max_age: float) -> bool:
        view = self.views[name]
        return view.dirty or time.time() - view.refreshed > max_age

    def cleanup(self, max_age: float) -> list[str]:
        """Drop the views that were not refreshed for ``max_age`` seconds."""
        old = [v.name for v in self.views.values() if time.time() - v.refreshed > max_age]
        for n in old:
            self.drop(n)
        return sorted(old)

    def stats(self) -> dict:
        v = self.views.values()
        return {"views": len(v), "dirty": sum(x.dirty for x in v), "stale_reads": sum(x.stale_reads for x in v), "refreshes": sum(x.refreshes for x in v)}
