"""Thin immutable handles over long-form DataFrames.

A series table has the key columns, ``tick`` (bigint), ``value`` and optionally tie-break columns
that order observations sharing a tick. Nothing is computed until Spark runs the plan; the one
exception is the bounded-key check of the order-based operators (see ``plans.ordered``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans import CHUNK_ROWS, add_chunk, frame, join_on, longest, row_index, running
from .trs import TRS


def as_column(expr) -> Column:
    """A Column, a SQL expression string, or a literal."""
    if isinstance(expr, Column):
        return expr
    return F.expr(expr) if isinstance(expr, str) else F.lit(expr)


@dataclass(frozen=True)
class TS:
    """One or many time series: ``keys`` name the group columns, ``ord`` the tie-breakers."""

    df: DataFrame
    keys: tuple[str, ...]
    ord: tuple[str, ...] = ()
    trs: TRS | None = None
    chunk_rows: int = CHUNK_ROWS
    known_max: int | None = None
    #: Gives ``df`` with the source already cut to about a range of ticks (None: no bound), as long as ``df`` is the table
    #: as it was read, but for operators that look at one observation at a time.
    within: Callable[[int | None, int | None], DataFrame] | None = field(default=None, compare=False, repr=False)

    @property
    def by(self) -> list[str]:
        """Order columns: tick, then the tie-breakers (or the value itself)."""
        return ["tick", *(self.ord or ("value",))]

    @property
    def columns(self) -> list[str]:
        return [*self.keys, "tick", *self.ord, "value"]

    def max_rows(self) -> int:
        """Upper bound on the rows of one series; counted once, then handed down the chain."""
        if self.known_max is None:
            object.__setattr__(self, "known_max", longest(self.df, self.keys))
        return self.known_max

    def bounded(self) -> bool:
        """Whether every series fits one task."""
        return self.max_rows() <= self.chunk_rows

    def rows(self) -> int | None:
        """Rows per task to ask for in the building blocks; None once every series is known to fit."""
        return None if self.bounded() else self.chunk_rows

    def with_df(self, df: DataFrame, fewer: bool = True, **changes) -> TS:
        """Same series layout over another frame; ``fewer``: no series can have gained rows."""
        return replace(self, df=df.drop("_chunk"), **{"known_max": self.known_max if fewer else None, "within": None, **changes})

    def each(self, change: Callable[[DataFrame], DataFrame], **changes) -> TS:
        """A change that looks at one observation at a time and keeps its tick: ranges still reach the source."""
        out, within = self.with_df(change(self.df), **changes), self.within
        return out if within is None else replace(out, within=lambda a, b: change(within(a, b)))

    def with_value(self, value, **changes) -> TS:
        return self.each(lambda df: df.withColumn("value", as_column(value)), **changes)

    # Order-based building blocks bound to this handle. The rows of a hot series are cut once per
    # operator; the cut stays on the frame (``_chunk``) until ``with_df`` takes it off.
    def _cut(self, df) -> DataFrame:
        df = self.df if df is None else df
        if self.bounded() or "_chunk" in df.columns:
            return df
        return add_chunk(df, self.keys, self.by, self.chunk_rows)[0]

    def running(self, specs, df=None) -> DataFrame:
        return running(self._cut(df), self.keys, self.by, specs, self.chunk_rows, self.bounded())

    def row_index(self, out="rn", df=None) -> DataFrame:
        return row_index(self._cut(df), self.keys, self.by, out, self.chunk_rows, self.bounded())

    def frame(self, exprs, before=0, after=0, df=None) -> DataFrame:
        return frame(self._cut(df), self.keys, self.by, exprs, before, after, self.chunk_rows, self.bounded())


@dataclass(frozen=True)
class Sliding:
    """Overlapping windows before any row is copied into them.

    ``df``: the series with ``_at``, the place of a row (row number, or ticks since the series'
    start), and ``_last``, the last segment of the series (null: none is left out). A window covers
    ``window`` places and starts every ``step`` places; ``first`` names the tick of place 0, if
    places are ticks.
    """

    df: DataFrame
    window: int
    step: int
    first: str | None = None


@dataclass(frozen=True)
class Segments:
    """Segmented series: a row per (key, segment, observation).

    ``has_bounds`` says that ``seg_start`` / ``seg_end`` are already columns; otherwise a segment
    spans its first to its last tick. ``sliding`` is set while the segments are overlapping windows
    that nothing was changed in, so aggregates need not copy rows.
    """

    df: DataFrame
    keys: tuple[str, ...]
    ord: tuple[str, ...] = ()
    has_bounds: bool = False
    chunk_rows: int = CHUNK_ROWS
    trs: TRS | None = None
    fits: bool = False
    sliding: Sliding | None = field(default=None, compare=False, repr=False)

    def rows(self) -> int | None:
        """Like ``TS.rows``: None when the series the segments come from fit a task."""
        return None if self.fits else self.chunk_rows

    @property
    def group(self) -> list[str]:
        return [*self.keys, "seg_id"]

    @property
    def by(self) -> list[str]:
        return ["tick", *(self.ord or ("value",))]

    def with_df(self, df: DataFrame, **changes) -> Segments:
        return replace(self, df=df, **{"sliding": None, **changes})

    def with_bounds(self) -> Segments:
        """Add ``seg_start`` / ``seg_end`` to every row."""
        if self.has_bounds:
            return self
        ends = self.df.groupBy(*self.group).agg(F.min("tick").alias("seg_start"), F.max("tick").alias("seg_end"))
        return self.with_df(join_on(self.df, ends, self.group), has_bounds=True)

    def bounds(self) -> DataFrame:
        """One row per segment: keys, seg_id, seg_start, seg_end, n."""
        start, end = ("seg_start", "seg_end") if self.has_bounds else ("tick", "tick")
        return self.df.groupBy(*self.group).agg(
            F.min(start).alias("seg_start"), F.max(end).alias("seg_end"), F.count(F.lit(1)).alias("n")
        )
