"""Tables to series and series to tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..handle import TS, as_column
from ..plans import CHUNK_ROWS
from ..trs import TRS, epoch_ms

_EPOCH = datetime(1970, 1, 1)
# Bounds outside the years that a timestamp literal can name are left out.
_LEAST_MS, _MOST_MS = (int((d - _EPOCH).total_seconds() * 1000) for d in (datetime(1, 1, 2), datetime(9999, 12, 30)))


def _tick(df: DataFrame, ts_column: str, trs: TRS | None):
    kind = df.schema[ts_column].dataType.simpleString()
    col = epoch_ms(F.col(ts_column), kind)
    if trs is None or kind in ("bigint", "int", "smallint", "tinyint"):
        return col  # integers are ticks already
    return trs.to_index(col)


def _bounds(df: DataFrame, ts_column: str, trs: TRS | None, start: int | None, end: int | None):
    """A condition on the source column that holds for every row whose tick lies in the range: the scan can use it."""
    kind, c = df.schema[ts_column].dataType.simpleString(), F.col(ts_column)
    if kind in ("bigint", "int", "smallint", "tinyint"):
        above = F.lit(True) if start is None else c >= F.lit(start)
        return above if end is None else above & (c <= F.lit(end))
    trs = trs or TRS()
    first = _LEAST_MS if start is None else trs.start_ms + start * trs.granularity_ms - 1
    last = _MOST_MS if end is None else trs.start_ms + (end + 1) * trs.granularity_ms
    make = {
        "timestamp": lambda ms: F.timestamp_millis(F.lit(ms)),
        "timestamp_ntz": lambda ms: F.lit(f"{_EPOCH + timedelta(milliseconds=ms):%Y-%m-%d %H:%M:%S.%f}").cast("timestamp_ntz"),
        "date": lambda ms: F.date_from_unix_date(F.lit(ms // 86_400_000)),
    }.get(kind)
    out = F.lit(True)
    if make and _LEAST_MS < first < _MOST_MS:
        out = out & (c >= make(first))
    if make and _LEAST_MS < last < _MOST_MS:
        out = out & (c <= make(last))
    return out


def _trs(granularity: timedelta | None, start_time: datetime | None) -> TRS | None:
    if granularity is None and start_time is None:
        return None
    base = TRS()
    return TRS(granularity or base.granularity, start_time or base.start_time)


def time_series(df, ts_column, value_column, granularity=None, start_time=None, ord=(), chunk_rows=CHUNK_ROWS) -> TS:
    """Table -> single time series (a constant key column ``series``).

    Timestamps become ticks of the time reference system ``(granularity, start_time)``; without one
    they are milliseconds. Integer columns are taken as ticks.
    """
    trs = _trs(granularity, start_time)
    ord = (ord,) if isinstance(ord, str) else tuple(ord)

    def made(rows):
        return rows.select(F.lit(0).alias("series"), _tick(df, ts_column, trs).alias("tick"), *ord, as_column(value_column).alias("value"))

    return TS(made(df), ("series",), ord, trs, chunk_rows, within=lambda a, b: made(df.where(_bounds(df, ts_column, trs, a, b))))


def multi_time_series(
    df, ts_column, key_column=None, value_column=None, instants=None, granularity=None, start_time=None, ord=(), chunk_rows=CHUNK_ROWS
) -> TS:
    """Table -> many series.

    Long form: ``key_column`` (one name or several) and ``value_column``. Wide form: ``instants``
    names the columns that each hold one series; the key is then the column name in ``key``.
    """
    trs = _trs(granularity, start_time)
    ord = (ord,) if isinstance(ord, str) else tuple(ord)
    tick = _tick(df, ts_column, trs)
    if instants is not None:
        wide = df.select(tick.alias("tick"), *ord, *[F.col(c) for c in instants])
        long = wide.unpivot(["tick", *ord], list(instants), "key", "value")
        return TS(long.select("key", "tick", *ord, "value"), ("key",), ord, trs, chunk_rows)
    keys = (key_column,) if isinstance(key_column, str) else tuple(key_column)

    def made(rows):
        return rows.select(*keys, tick.alias("tick"), *ord, as_column(value_column).alias("value"))

    return TS(made(df), keys, ord, trs, chunk_rows, within=lambda a, b: made(df.where(_bounds(df, ts_column, trs, a, b))))


def multi_from_dict(series: Mapping[str, TS]) -> TS:
    """Several single series -> one multi series keyed by the mapping's names (column ``key``)."""
    first = next(iter(series.values()))
    out = None
    for name, ts in series.items():
        part = ts.df.select(F.lit(name).alias("key"), "tick", *ts.ord, "value")
        out = part if out is None else out.unionByName(part)
    return TS(out, ("key",), first.ord, first.trs, first.chunk_rows)


def to_df(ts: TS, timestamps: bool = True) -> DataFrame:
    """Series -> table; with a TRS the tick's lower bound is added as a ``timestamp`` column."""
    out = ts.df.select(*ts.keys, "tick", "value")
    if timestamps and ts.trs is not None:
        ms = ts.trs.to_long_lower(F.col("tick"))
        out = out.withColumn("timestamp", F.timestamp_millis(ms))
    return out


def to_df_observations(ts: TS) -> DataFrame:
    """Long table (keys, tick, value)."""
    return ts.df.select(*ts.keys, "tick", "value")


def to_df_instants(ts: TS, keys: Sequence) -> DataFrame:
    """Wide table: one column per key in ``keys`` (the list must be given, so the schema is fixed)."""
    (key,) = ts.keys
    return ts.df.groupBy("tick").pivot(key, list(keys)).agg(F.min_by("value", F.struct(*ts.ord, "value")))
