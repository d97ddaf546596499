"""Element-wise and whole-series operators. ``expr`` arguments are Columns or SQL text over ``value``/``tick``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..handle import TS, as_column
from ..plans import join_on
from ..trs import TRS


def map_values(ts: TS, expr) -> TS:
    """Replace every value."""
    return ts.with_value(expr)


def map_with_index(ts: TS, expr) -> TS:
    """Replace every value; ``rn`` is the 0-based index of the observation in its series."""
    return ts.with_df(ts.row_index("rn").withColumn("value", as_column(expr)).drop("rn"))


def flatmap(ts: TS, array_expr) -> TS:
    """One value to many values at the same tick; the position joins the tie-breakers."""
    name = f"pos{len(ts.ord)}"
    items = F.posexplode(as_column(array_expr)).alias(name, "value")
    return ts.each(lambda df: df.select(*ts.keys, "tick", *ts.ord, items), fewer=False, ord=(*ts.ord, name))


def filter_values(ts: TS, pred) -> TS:
    """Keep observations where ``pred`` is true."""
    return ts.each(lambda df: df.where(as_column(pred)))


def filter_series(ts: TS, condition) -> TS:
    """Keep whole series whose aggregate ``condition`` (e.g. ``avg(value) > 3``) is true."""
    keep = ts.df.groupBy(*ts.keys).agg(as_column(condition).alias("_keep")).where("_keep").select(*ts.keys)
    return ts.with_df(join_on(ts.df, keep, ts.keys, "left_semi"))


def filter_series_key(ts: TS, pred) -> TS:
    """Keep series whose key satisfies ``pred``."""
    return ts.each(lambda df: df.where(as_column(pred)))


def map_series(ts: TS, fn, value_type: str = "double", before: int = 0, after: int = 0) -> TS:
    """Apply ``fn(pdf) -> pdf`` to each series (columns ``tick``, tie-breakers, ``value``), in order."""
    return map_series_with_key(ts, lambda _key, pdf: fn(pdf), value_type)


def map_series_with_key(ts: TS, fn, value_type: str = "double") -> TS:
    """Like ``map_series`` with the key tuple as first argument.

    The function needs its series whole, so a series above ``chunk_rows`` is refused with an error;
    ``fold_series`` runs a resumable function over series of any length.
    """
    if not ts.bounded():
        raise ValueError("a series is longer than chunk_rows: use fold_series with a resumable function")
    by, keys, ord = ts.by, ts.keys, ts.ord
    schema = ", ".join(
        [f"`{c}` {ts.df.schema[c].dataType.simpleString()}" for c in (*keys, "tick", *ord)] + [f"value {value_type}"]
    )

    def run(key, pdf):
        out = fn(key, pdf.sort_values(by).drop(columns=list(keys)).reset_index(drop=True))
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "tick", *ord, "value"]]

    return ts.with_df(ts.df.select(*ts.columns).groupBy(*keys).applyInPandas(run, schema), fewer=False)


def fold_series(ts: TS, step, init: str, value_type: str = "double", rows: int | None = None) -> TS:
    """Resumable series function: ``step(block, state) -> (rows, state)`` over ordered blocks."""
    from ..plans import fold

    schema = ", ".join(
        [f"`{c}` {ts.df.schema[c].dataType.simpleString()}" for c in ("tick", *ts.ord)] + [f"value {value_type}"]
    )
    out = fold(ts.df, ts.keys, ts.by, ["tick", *ts.ord, "value"], step, init, schema, rows or min(ts.chunk_rows, 100_000))
    return ts.with_df(out.select(*ts.columns), fewer=False)


def map_series_key(ts: TS, expr, check: bool = True) -> TS:
    """Rename keys by an expression into column ``key``; two old keys must not get one new name."""
    new = ts.df.withColumn("_new", as_column(expr))
    if check:
        clash = (
            new.select("_new", *ts.keys).distinct().groupBy("_new").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        )
        if not clash.isEmpty():
            raise ValueError("map_series_key: new keys are not unique")
    df = new.select(F.col("_new").alias("key"), "tick", *ts.ord, "value")
    return ts.with_df(df, keys=("key",))


def keys(ts: TS) -> DataFrame:
    return ts.df.select(*ts.keys).distinct()


def get_time_series(ts: TS, *key) -> TS:
    """The one series with this key."""
    cond = F.lit(True)
    for k, v in zip(ts.keys, key, strict=True):
        cond = cond & F.col(k).eqNullSafe(F.lit(v))
    return ts.with_df(ts.df.where(cond))


def get_values(ts: TS, start: int, end: int, inclusive: bool = False) -> TS:
    """Observations with ``start <= tick <= end``.

    ``inclusive`` also returns the nearest tick outside the range on either side of each series when
    the bound itself is not a tick. After a table is read, and after operators that look at one
    observation at a time, the range also reaches its scan: for neighbours that is one scan with a
    bound for each side, of which every task keeps the nearest tick per series.
    """
    tick = F.col("tick")
    if not inclusive:
        df = ts.within(start, end) if ts.within else ts.df
        return ts.with_df(df.where((tick >= start) & (tick <= end)))
    if ts.within and start < end:

        def nearest(df, order):
            return df.withColumn("_rank", F.rank().over(Window.partitionBy(*ts.keys).orderBy(order))).where("_rank = 1").drop("_rank")

        inside = ts.within(start, end).where((tick > start) & (tick < end))
        below = nearest(ts.within(None, start).where(tick <= start), tick.desc())
        above = nearest(ts.within(end, None).where(tick >= end), tick.asc())
        return ts.with_df(inside.unionByName(below).unionByName(above))
    lo = F.max(F.when(tick <= start, tick)).alias("_lo")
    hi = F.min(F.when(tick >= end, tick)).alias("_hi")
    ends = ts.df.groupBy(*ts.keys).agg(lo, hi)
    df = join_on(ts.df, ends, ts.keys)
    keep = (tick >= F.coalesce("_lo", F.lit(start))) & (tick <= F.coalesce("_hi", F.lit(end)))
    return ts.with_df(df.where(keep).drop("_lo", "_hi"))


def collect_series(ts: TS) -> DataFrame:
    """Ordered packed arrays ``observations`` of (tick, value): one row per series and chunk.

    ``chunk`` is 0 for every series of at most ``chunk_rows`` rows; longer series come as several
    rows whose arrays follow each other.
    """
    df, group = ts.df, list(ts.keys)
    item = F.struct(*ts.by, *([] if "value" in ts.by else ["value"]))
    if ts.bounded():
        packed = df.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("o")).withColumn("chunk", F.lit(0).cast("long"))
    else:
        df = ts.row_index("_rn").withColumn("chunk", F.floor(F.col("_rn") / ts.chunk_rows))
        packed = df.groupBy(*group, "chunk").agg(F.array_sort(F.collect_list(item)).alias("o"))
    obs = F.transform("o", lambda s: F.struct(s["tick"].alias("tick"), s["value"].alias("value")))
    return packed.select(*group, "chunk", obs.alias("observations"))


def unpack(df: DataFrame, keys, chunk_rows=None) -> TS:
    """Packed arrays -> series. Ticks may repeat; the array position breaks ties."""
    rows = df.select(*keys, F.posexplode("observations").alias("pos", "o"))
    out = rows.select(*keys, F.col("o.tick").alias("tick"), "pos", F.col("o.value").alias("value"))
    return TS(out, tuple(keys), ("pos",))


def count(ts: TS) -> DataFrame:
    return ts.df.groupBy(*ts.keys).agg(F.count(F.lit(1)).alias("count"))


def concat(ts: TS, other: TS, check: bool = True) -> TS:
    """Append ``other`` after ``ts``; it must start after ``ts`` ends, per key."""
    if check:
        last = ts.df.groupBy(*ts.keys).agg(F.max("tick").alias("_last"))
        first = other.df.groupBy(*ts.keys).agg(F.min("tick").alias("_first"))
        if not join_on(last, first, ts.keys).where("_last >= _first").isEmpty():
            raise ValueError("concat: the second series starts before the first ends")
    return ts.with_df(ts.df.select(*ts.columns).unionByName(other.df.select(*ts.columns)), fewer=False)


def lag(ts: TS, lag_amount: int) -> TS:
    """Keep the observations from the ``lag_amount``-th row on (fewer points, same ticks)."""
    return ts.with_df(ts.row_index("_rn").where(F.col("_rn") >= lag_amount).drop("_rn"))


def shift(ts: TS, shift_amount: int, default_value=None) -> TS:
    """Keep ticks and move values ``shift_amount`` rows later (negative: earlier)."""
    n = abs(shift_amount)
    move = F.lag if shift_amount >= 0 else F.lead
    df = ts.frame(
        lambda w: {"_moved": move("value", n, default_value).over(w)},
        before=n if shift_amount > 0 else 0,
        after=n if shift_amount < 0 else 0,
    )
    if ts.ord:
        return ts.with_df(df.withColumn("value", F.col("_moved")).drop("_moved"))
    return ts.with_df(df.withColumn("value", F.col("_moved")).drop("_moved"))


def with_trs(ts: TS, granularity, start_time) -> TS:
    """Re-express ticks in another time reference system."""
    from .create import _trs

    new, old = _trs(granularity, start_time), ts.trs or TRS()
    tick = new.to_index(old.to_long_lower(F.col("tick")))
    return ts.with_df(ts.df.withColumn("tick", tick), trs=new)
