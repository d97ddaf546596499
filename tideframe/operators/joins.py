"""Temporal joins and alignment.

The result value is ``struct(left, right)``, or ``join_func`` applied to the columns ``left`` and
``right``. ``left_outer`` / ``right_outer`` return the part of one side that has no partner. When the
other side is a single series (key column ``series``) it meets every series of a multi series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.interpolators import Interpolator
from ..handle import TS, as_column
from .fill import fill_column


def _sides(left: TS, right: TS) -> tuple[DataFrame, DataFrame, list[str]]:
    on = [*left.keys, "tick"]
    a = left.df.select(*on, F.col("value").alias("left"), F.lit(True).alias("_l"))
    b = right.df.select(*on, F.col("value").alias("right"), F.lit(True).alias("_r"))
    return a, b, on


def _fits(left: TS, right: TS) -> bool | None:
    """True when the rows of both sides of a key fit a task together; None: look at the joined rows."""
    return True if left.max_rows() + right.max_rows() <= left.chunk_rows else None


def joined(left: TS, right: TS, how: str, left_interp: Interpolator | None = None, right_interp: Interpolator | None = None) -> DataFrame:
    """Rows (keys, tick, left, right) of the join ``how``: inner, full, left, right, left_outer, right_outer."""
    if set(right.keys) != set(left.keys):
        return _joined_single(left, right, how, right_interp)
    a, b, on = _sides(left, right)
    if how in ("left_outer", "right_outer"):
        keep, other = (a, b) if how == "left_outer" else (b, a)
        out = keep.join(other, on, "left_anti")
        name = "right" if how == "left_outer" else "left"
        kind = (right if how == "left_outer" else left).df.schema["value"].dataType
        return out.withColumn(name, F.lit(None).cast(kind)).select(*on, "left", "right")
    if how == "inner" or not (left_interp or right_interp):
        return a.join(b, on, how).select(*on, "left", "right")
    if how in ("left", "right") and not (left_interp if how == "left" else right_interp):
        # As-of: the kept side's rows look into the other side; one shuffle, no tick join.
        keep, look, col, interp = (a, b, "right", right_interp) if how == "left" else (b, a, "left", left_interp)
        mark = "_l" if how == "left" else "_r"
        both = look.unionByName(keep, allowMissingColumns=True).withColumn("_known", F.col(mark).isNull())
        side = F.when(F.col("_known"), 0).otherwise(1)
        ahead = interp.future_size and not interp.history_size
        both = both.withColumn("_side", -side if ahead else side)
        out = fill_column(both, left.keys, ["tick", "_side"], col, interp, left.chunk_rows, _fits(left, right), known="_known")
        return out.where(F.col(mark)).select(*on, "left", "right")
    full = a.join(b, on, "full")
    for col, interp in (("left", left_interp), ("right", right_interp)):
        if interp:
            full = fill_column(full, left.keys, ["tick"], col, interp, left.chunk_rows, _fits(left, right))
    if how != "full":
        full = full.where(F.col("_l" if how == "left" else "_r"))
    return full.select(*on, "left", "right")


def _joined_single(left: TS, right: TS, how: str, right_interp: Interpolator | None) -> DataFrame:
    """Join every series of ``left`` with one single series: a join on the tick alone."""
    if right.keys != ("series",) or how not in ("inner", "left", "left_outer"):
        raise ValueError("both sides need the same key columns, or the right side a single series (inner, left, left_outer)")
    if how == "left" and right_interp:
        # Each distinct left tick looks the value up once.
        ticks = left.df.select("tick").distinct().select(F.lit(0).alias("series"), "tick")
        asked = TS(ticks.withColumn("value", F.lit(True)), ("series",), (), None, left.chunk_rows)
        b = joined(asked, right, "left", None, right_interp).select("tick", "right")
    else:
        b = right.df.select("tick", F.col("value").alias("right"))
    a = left.df.select(*left.keys, "tick", F.col("value").alias("left"))
    if how == "left_outer":
        kind = right.df.schema["value"].dataType
        return a.join(b, "tick", "left_anti").withColumn("right", F.lit(None).cast(kind))
    return a.join(b, "tick", how).select(*left.keys, "tick", "left", "right")


def join(left: TS, right: TS, how: str, join_func=None, left_interp_func=None, right_interp_func=None) -> TS:
    df = joined(left, right, how, left_interp_func, right_interp_func)
    value = F.struct("left", "right") if join_func is None else as_column(join_func(F.col("left"), F.col("right")) if callable(join_func) else join_func)
    out = df.select(*left.keys, "tick", value.alias("value"))
    return TS(out, left.keys, (), left.trs, left.chunk_rows)


def inner_join(left: TS, right: TS, join_func=None) -> TS:
    """Ticks in both."""
    return join(left, right, "inner", join_func)


def full_join(left, right, join_func=None, left_interp_func=None, right_interp_func=None) -> TS:
    """Ticks in either."""
    return join(left, right, "full", join_func, left_interp_func, right_interp_func)


def left_join(left, right, join_func=None, right_interp_func=None) -> TS:
    """All left ticks; with ``prev`` as interpolator this is the as-of join."""
    return join(left, right, "left", join_func, None, right_interp_func)


def right_join(left, right, join_func=None, left_interp_func=None) -> TS:
    """All right ticks."""
    return join(left, right, "right", join_func, left_interp_func, None)


def left_outer_join(left, right, join_func=None) -> TS:
    """Left ticks without a right partner."""
    return join(left, right, "left_outer", join_func)


def right_outer_join(left, right, join_func=None) -> TS:
    """Right ticks without a left partner."""
    return join(left, right, "right_outer", join_func)


def align2(left: TS, right: TS, how: str, left_interp_func=None, right_interp_func=None) -> tuple[TS, TS]:
    """Two series on the shared ticks of the join ``how``."""
    df = joined(left, right, how, left_interp_func, right_interp_func)
    make = lambda c: TS(df.select(*left.keys, "tick", F.col(c).alias("value")), left.keys, (), left.trs, left.chunk_rows)
    return make("left"), make("right")


def inner_align(left, right):
    return align2(left, right, "inner")


def full_align(left, right, left_interp_func=None, right_interp_func=None):
    return align2(left, right, "full", left_interp_func, right_interp_func)


def left_align(left, right, right_interp_func=None):
    return align2(left, right, "left", None, right_interp_func)


def right_align(left, right, left_interp_func=None):
    return align2(left, right, "right", left_interp_func, None)


def left_outer_align(left, right):
    return align2(left, right, "left_outer")


def right_outer_align(left, right):
    return align2(left, right, "right_outer")


def align(ts: TS, interp: Interpolator, key=None) -> TS:
    """Put every series on the ticks of one series (``key``), or on the ticks of all of them.

    A series takes the ticks that lie between its own first and last one.
    """
    source = ts.df
    if key is not None:
        values = key if isinstance(key, tuple) else (key,)
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(ts.keys, values, strict=True)])
        source = source.where(cond)
    ticks = source.select(F.col("tick")).distinct()
    span = ts.df.groupBy(*ts.keys).agg(F.min("tick").alias("_a"), F.max("tick").alias("_b"))
    # Buckets of some ten thousand rows on average, so the join has more groups the more there is to join.
    first, last, rows = ts.df.agg(F.min("tick"), F.max("tick"), F.count(F.lit(1))).first()
    width = max(1, ((last or 0) - (first or 0)) // max(1024, rows // 10_000) + 1)
    spots = F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width)))
    wanted = (
        span.withColumn("_bucket", spots)
        .join(ticks.withColumn("_bucket", F.floor(F.col("tick") / width)), "_bucket")
        .where("tick BETWEEN _a AND _b")
        .select(*ts.keys, "tick", F.lit(1).alias("_side"))
    )
    ahead = interp.future_size and not interp.history_size
    both = ts.df.withColumn("_side", F.lit(0)).unionByName(wanted, allowMissingColumns=True).withColumn("_known", F.col("_side") == 0)
    if ahead:
        both = both.withColumn("_side", -F.col("_side"))
    out = fill_column(both, ts.keys, ["tick", "_side", *ts.ord], "value", interp, ts.chunk_rows, None, known="_known")
    return ts.with_df(out.where("NOT _known").select(*ts.keys, "tick", "value"), fewer=False, ord=())


def interval_join(left: TS, right: TS, left_delta: int, right_delta: int, join_func=None) -> TS:
    """Every right observation within ``[tick - left_delta, tick + right_delta]`` of a left one.

    Result value ``struct(left, right_tick, right)``. Ticks are bucketed by the interval's width, so
    each left row meets at most two buckets.
    """
    df = within(left.df, right.df, left.keys, left_delta, right_delta)
    value = F.struct("left", "right_tick", "right") if join_func is None else as_column(join_func(F.col("left"), F.col("right")))
    return TS(df.select(*left.keys, "tick", value.alias("value")), left.keys, (), left.trs, left.chunk_rows)


def within(left: DataFrame, right: DataFrame, keys, left_delta: int, right_delta: int, keep=()) -> DataFrame:
    """Rows (keys, tick, left, right_tick, right, *keep) with the right tick in the interval around the left tick."""
    width = left_delta + right_delta + 1
    lo, hi = F.col("tick") - left_delta, F.col("tick") + right_delta
    spots = F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    a = left.select(*keys, "tick", F.col("value").alias("left"), *keep, spots.alias("_bucket"))
    b = right.select(
        *keys, F.col("tick").alias("right_tick"), F.col("value").alias("right"), F.floor(F.col("tick") / width).alias("_bucket")
    )
    gap = F.col("right_tick") - F.col("tick")
    out = a.join(b, [*keys, "_bucket"]).where((gap >= -left_delta) & (gap <= right_delta))
    return out.select(*keys, "tick", "left", "right_tick", "right", *keep)
