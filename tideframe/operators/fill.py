"""Filling, resampling, as-of lookup: everything that reads the observations around a tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.interpolators import Interpolator
from ..handle import TS
from ..plans import frame, running

_GRID_BLOCK = 10_000


def fill_column(
    df: DataFrame, keys, by, col: str, interp: Interpolator, rows: int, bounded: bool | None, known: str | None = None, exact: bool = True
) -> DataFrame:
    """Replace nulls of ``col`` by interpolation along each series (``by[0]`` must be ``tick``).

    ``known`` names a boolean column that marks rows whose null is a real observation.
    ``exact``: a missing row at the tick of an observation takes that observation's value.
    """
    h, f = interp.history_size, interp.future_size
    missing = F.col(col).isNull() if known is None else F.col(col).isNull() & ~F.col(known)
    kind = df.schema[col].dataType
    obs = F.when(F.col(col).isNotNull(), F.struct("tick", F.col(col).alias("value")))
    empty = F.array().cast(f"array<struct<tick:bigint,value:{kind.simpleString()}>>")
    if h <= 1 and f <= 1:
        specs = {}
        if h or (exact and not f):
            specs["_p"] = ("last", "_obs")
        if f:
            specs["_n"] = ("first", "_obs")
        if not specs:
            return df.withColumn(col, F.when(missing, interp.expr(F.col("tick"), empty, empty).cast(kind)).otherwise(F.col(col)))
        df = running(df.withColumn("_obs", obs), keys, by, specs, rows, bounded)
        hist = F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(empty) if "_p" in specs else empty
        fut = F.when(F.col("_n").isNotNull(), F.array("_n")).otherwise(empty) if "_n" in specs else empty
        drop = ["_obs", *specs]
    else:
        # The last h / next f observations are gathered on observed rows only, then carried.
        seen = frame(
            df.where(F.col(col).isNotNull()).withColumn("_obs", obs),
            keys,
            by,
            lambda w: {
                "_h": F.collect_list("_obs").over(w.rowsBetween(-(max(h, 1) - 1), 0)),
                "_f": F.collect_list("_obs").over(w.rowsBetween(0, max(f, 1) - 1)),
            },
            before=max(h, 1) - 1,
            after=max(f, 1) - 1,
            rows=rows,
            bounded=bounded,
        ).drop("_obs")
        df = seen.unionByName(df.where(F.col(col).isNull()), allowMissingColumns=True)
        df = running(df, keys, by, {"_p": ("last", "_h"), "_n": ("first", "_f")}, rows, bounded)
        hist, fut = F.coalesce("_p", empty), F.coalesce("_n", empty)
        drop = ["_h", "_f", "_p", "_n"]
    value = interp.expr(F.col("tick"), hist, fut).cast(kind)
    if exact:
        near = F.try_element_at(fut, F.lit(1)) if f and not h else F.try_element_at(hist, F.lit(-1))
        value = F.when(near.isNotNull() & (near["tick"] == F.col("tick")), near["value"]).otherwise(value)
    return df.withColumn(col, F.when(missing, value).otherwise(F.col(col))).drop(*drop)


def fillna(ts: TS, interp: Interpolator, null_value=None) -> TS:
    """Replace nulls (and ``null_value``) by the interpolator's value."""
    df = ts.df
    if null_value is not None:
        df = df.withColumn("value", F.when(F.col("value") != F.lit(null_value), F.col("value")))
    by = ts.by if ts.ord else ["tick"]
    return ts.with_df(fill_column(df, ts.keys, by, "value", interp, ts.chunk_rows, ts.bounded(), exact=False))


def grid(ts: TS, period: int) -> tuple[DataFrame, int]:
    """Regular ticks first, first+period, ... up to the last tick of each series, and the longest length."""
    ends = ts.df.groupBy(*ts.keys).agg(
        F.min("tick").alias("_a"), F.max("tick").alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    steps = F.floor((F.col("_b") - F.col("_a")) / F.lit(period))
    longest = ends.agg(F.max(steps + 1 + F.col("_n"))).first()[0] or 0
    blocks = ends.withColumn("_steps", steps)
    if longest <= _GRID_BLOCK:
        out = blocks.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_steps"))))
    else:
        # A long grid is made block by block, spread over tasks, never as one array.
        first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_steps") / _GRID_BLOCK)))
        blocks = blocks.withColumn("_g", first).repartition(*ts.keys, "_g")
        lo = F.col("_g") * _GRID_BLOCK
        out = blocks.withColumn("_k", F.explode(F.sequence(lo, F.least(lo + _GRID_BLOCK - 1, F.col("_steps")))))
    return out.select(*ts.keys, (F.col("_a") + F.col("_k") * period).alias("tick")), longest


def resample(ts: TS, period: int, interp: Interpolator) -> TS:
    """Regular series from the first tick in steps of ``period``; never past the last tick."""
    ticks, longest = grid(ts, period)
    both = ts.df.withColumn("_side", F.lit(0)).unionByName(ticks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    by = ["tick", "_side", *(ts.ord or ("value",))]
    if interp.future_size and not interp.history_size:
        by[1] = "_before"  # the next observation may sit on the grid tick itself
        both = both.withColumn("_before", -F.col("_side"))
    filled = fill_column(
        both.withColumn("_known", F.col("_side") == 0), ts.keys, by, "value", interp, ts.chunk_rows,
        longest <= ts.chunk_rows, known="_known",
    )
    out = filled.where("_side = 1").select(*ts.keys, "tick", "value")
    return ts.with_df(out, ord=(), known_max=longest)


def probe(ts: TS, probes: DataFrame, kind: str, tick_col: str = "t") -> DataFrame:
    """Nearest observation for each probe row (keys, ``tick_col``): floor, lower, ceiling or higher.

    Adds ``tick`` and ``value`` (null when there is none). Probes of unknown keys are kept.
    """
    back, inclusive = {"floor": (True, True), "lower": (True, False), "ceiling": (False, True), "higher": (False, False)}[kind]
    extra = [c for c in probes.columns if c not in (*ts.keys, tick_col)]
    data_first = 0 if back == inclusive else 1
    data = ts.df.select(
        *ts.keys, "tick", F.lit(data_first).alias("_side"), *ts.ord, F.struct("tick", "value").alias("_obs"), F.lit(False).alias("_probe")
    )
    ask = probes.select(
        *ts.keys, F.col(tick_col).cast("long").alias("tick"), F.lit(1 - data_first).alias("_side"), F.lit(True).alias("_probe"), *extra
    )
    both = data.unionByName(ask, allowMissingColumns=True)
    spec = ("last", "_obs") if back else ("first", "_obs")
    by = ["tick", "_side", *ts.ord]
    out = running(both, ts.keys, by, {"_hit": spec}, ts.chunk_rows).where("_probe")
    return out.select(
        *ts.keys, F.col("tick").alias(tick_col), *extra, F.col("_hit.tick").alias("tick"), F.col("_hit.value").alias("value")
    )


def floor(ts: TS, probes: DataFrame, tick_col="t") -> DataFrame:
    """Last observation at or before each probe."""
    return probe(ts, probes, "floor", tick_col)


def lower(ts: TS, probes: DataFrame, tick_col="t") -> DataFrame:
    """Last observation before each probe."""
    return probe(ts, probes, "lower", tick_col)


def ceiling(ts: TS, probes: DataFrame, tick_col="t") -> DataFrame:
    """First observation at or after each probe."""
    return probe(ts, probes, "ceiling", tick_col)


def higher(ts: TS, probes: DataFrame, tick_col="t") -> DataFrame:
    """First observation after each probe."""
    return probe(ts, probes, "higher", tick_col)


def first(ts: TS) -> DataFrame:
    """First observation of each series."""
    hit = F.min_by(F.struct("tick", "value"), F.struct(*ts.by))
    return ts.df.groupBy(*ts.keys).agg(hit.alias("o")).select(*ts.keys, "o.tick", "o.value")


def last(ts: TS) -> DataFrame:
    """Last observation of each series."""
    hit = F.max_by(F.struct("tick", "value"), F.struct(*ts.by))
    return ts.df.groupBy(*ts.keys).agg(hit.alias("o")).select(*ts.keys, "o.tick", "o.value")


def contains(ts: TS, probes: DataFrame, tick_col="t") -> DataFrame:
    """Adds ``found``: is there an observation at the probe's tick."""
    ticks = ts.df.select(*ts.keys, F.col("tick").alias(tick_col)).distinct().withColumn("_hit", F.lit(True))
    out = probes.join(ticks, [*ts.keys, tick_col], "left")
    return out.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def size(ts: TS, keys: DataFrame | None = None) -> DataFrame:
    """Number of observations per key, 0 for keys of ``keys`` without any; and ``is_empty``."""
    n = ts.df.groupBy(*ts.keys).agg(F.count(F.lit(1)).alias("size"))
    if keys is not None:
        n = keys.select(*ts.keys).distinct().join(n, list(ts.keys), "left")
    n = n.withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    return n.withColumn("is_empty", F.col("size") == 0)
