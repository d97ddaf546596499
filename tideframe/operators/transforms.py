"""Transformers: series to series."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_quantile
from ..handle import TS, as_column
from ..plans import join_on
from .joins import joined
from .scan import decay_scan


def transform(ts: TS, step: Callable[..., TS], *args, **kwargs) -> TS:
    """Apply a transformer: any function of a series that returns a series."""
    return step(ts, *args, **kwargs)


def transform2(left: TS, right: TS, expr) -> TS:
    """Two series to one on their shared ticks; ``expr`` over ``left`` and ``right``."""
    df = joined(left, right, "inner").select(*left.keys, "tick", as_column(expr).alias("value"))
    return TS(df, left.keys, (), left.trs, left.chunk_rows)


def difference(ts: TS) -> TS:
    """Value minus the value before; the first observation has none and is dropped."""
    df = ts.frame(
        lambda w: {"_d": F.col("value") - F.lag("value").over(w), "_first": F.lag("tick").over(w).isNull()}, before=1
    )
    return ts.with_df(df.where("NOT _first").withColumn("value", F.col("_d")).drop("_d", "_first"))


def z_score(ts: TS, mean: float | None = None, std: float | None = None) -> TS:
    """Zero mean, unit (sample) deviation; ``mean`` / ``std`` override the series' own."""
    stats = ts.df.groupBy(*ts.keys).agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    df = join_on(ts.df, stats, ts.keys) if mean is None or std is None else ts.df
    mu = F.col("_mean") if mean is None else F.lit(float(mean))
    sd = F.col("_std") if std is None else F.lit(float(std))
    return ts.with_df(df.withColumn("value", F.try_divide(F.col("value") - mu, sd)).drop("_mean", "_std"))


def ema(ts: TS, smoothing: float) -> TS:
    """Exponential moving average ``e = smoothing * value + (1 - smoothing) * e_before``, from the first value.

    Null values are skipped (they get no observation in the result).
    """
    clean = ts.with_df(ts.df.where(F.col("value").isNotNull()))
    df = clean.row_index("_rn")
    x = F.when(F.col("_rn") == 0, F.col("value").cast("double")).otherwise(F.col("value") * smoothing)
    df = decay_scan(df.withColumn("_x", x), ts.keys, "_rn", "_x", 1.0 - smoothing, clean.max_rows(), "_e")
    return clean.with_df(df.withColumn("value", F.col("_e")).drop("_e", "_x", "_rn"))


def paa(ts: TS, m: int) -> TS:
    """Piecewise aggregate approximation: ``m`` frames of equal length, each its mean, at the frame's first tick."""
    n = ts.df.groupBy(*ts.keys).agg(F.count(F.lit(1)).alias("_n"))
    df = join_on(ts.row_index("_rn"), n, ts.keys).withColumn("frame", F.floor(F.col("_rn") * m / F.col("_n")))
    out = df.groupBy(*ts.keys, "frame").agg(F.min("tick").alias("tick"), F.avg("value").alias("value"))
    return ts.with_df(out.select(*ts.keys, "tick", "frame", "value"), ord=("frame",))


def sax(ts: TS, min_value: float, max_value: float, num_bins: int) -> TS:
    """Letters a, b, c, ... for ``num_bins`` even bins over [min_value, max_value]; values outside are clamped."""
    b = F.floor((F.col("value") - min_value) / ((max_value - min_value) / num_bins))
    b = F.least(F.lit(num_bins - 1), F.greatest(F.lit(0), b))
    letter = F.when(F.col("value").isNotNull(), F.char(b + 97))
    return ts.with_value(letter)


def remove_consecutive_duplicate_values(ts: TS) -> TS:
    """Drop observations that repeat the value before them (nulls count as equal)."""
    df = ts.frame(
        lambda w: {"_prev": F.lag("value").over(w), "_first": F.lag("tick").over(w).isNull()}, before=1
    )
    keep = F.col("_first") | ~F.col("_prev").eqNullSafe(F.col("value"))
    return ts.with_df(df.where(keep).drop("_prev", "_first"))


def combine_duplicate_time_ticks(ts: TS, combine="avg(value)") -> TS:
    """Merge observations that share a tick by an aggregate expression over ``value``."""
    df = ts.df.groupBy(*ts.keys, "tick").agg(as_column(combine).alias("value"))
    return ts.with_df(df, ord=())


def _noise(ts: TS, seed: int) -> Column:
    """Standard normal noise that depends only on (seed, key, tick, tie-breakers): the same on every run."""

    def uniform(salt: int) -> Column:
        h = F.xxhash64(F.lit(seed * 2 + salt), *ts.keys, "tick", *ts.ord)
        return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * math.pi * uniform(1))


def awgn(ts: TS, mean: float = 0.0, sd: float = 1.0, seed: int = 0) -> TS:
    """Additive white Gaussian noise."""
    return ts.with_value(F.col("value") + mean + sd * _noise(ts, seed))


def mwgn(ts: TS, mean: float = 1.0, sd: float = 1.0, seed: int = 0) -> TS:
    """Multiplicative white Gaussian noise."""
    return ts.with_value(F.col("value") * (mean + sd * _noise(ts, seed)))


def decompose(ts: TS, samples_per_season: int, multiplicative: bool = False) -> TS:
    """Value becomes ``struct(trend, seasonal, residual)``.

    Trend: centred moving average over a season (null where it would leave the series). Seasonal: mean
    deviation from the trend per phase, shifted to sum to 0 (multiplicative: scaled to average 1).
    """
    m = samples_per_season
    half = m // 2
    value = F.col("value")

    def window(w):
        inner = F.sum("value").over(w.rowsBetween(-half, half) if m % 2 else w.rowsBetween(-half + 1, half - 1))
        if m % 2:
            mean = inner / m
        else:
            mean = (inner + 0.5 * (F.lag("value", half).over(w) + F.lead("value", half).over(w))) / m
        whole = F.lag("tick", half).over(w).isNotNull() & F.lead("tick", half).over(w).isNotNull()
        return {"trend": F.when(whole, mean)}

    df = ts.frame(window, before=half, after=half, df=ts.row_index("_rn"))
    dev = F.try_divide(value, F.col("trend")) if multiplicative else value - F.col("trend")
    df = df.withColumn("_dev", dev).withColumn("_phase", F.col("_rn") % m)
    phase = df.groupBy(*ts.keys, "_phase").agg(F.avg("_dev").alias("_s"))
    level = phase.groupBy(*ts.keys).agg(F.avg("_s").alias("_mean"))
    phase = join_on(phase, level, ts.keys)
    seasonal = F.try_divide("_s", "_mean") if multiplicative else F.col("_s") - F.col("_mean")
    df = join_on(df, phase.select(*ts.keys, "_phase", seasonal.alias("seasonal")), [*ts.keys, "_phase"])
    rest = F.try_divide(value, F.col("trend") * F.col("seasonal")) if multiplicative else value - F.col("trend") - F.col("seasonal")
    parts = F.struct("trend", "seasonal", rest.alias("residual"))
    order = ts.ord or ()
    return ts.with_df(df.select(*ts.keys, "tick", *order, parts.alias("value")))


def ljung_box(ts: TS, num_lags: int, period: int, step: int | None = None) -> TS:
    """Ljung-Box statistic of each window of ``period`` rows: value ``struct(q, p_value)``."""
    from . import reducers, segments

    segs = segments.segment(ts, period, step or period)
    return segments.transform(segs, reducers.ljung_box(num_lags))


def one_step(ts: TS, smoothing: float) -> TS:
    """Adds ``forecast``: the exponential average of the observations before each one."""
    df = ts.row_index("_rn", ts.df.where(F.col("value").isNotNull()))
    x = F.when(F.col("_rn") == 0, F.col("value").cast("double")).otherwise(F.col("value") * smoothing)
    df = decay_scan(df.withColumn("_x", x), ts.keys, "_rn", "_x", 1.0 - smoothing, ts.max_rows(), "_e")
    return ts.with_df(ts.frame(lambda w: {"forecast": F.lag("_e").over(w)}, before=1, df=df).drop("_e", "_x", "_rn"))


def detect_anomalies(ts: TS, model: float | DataFrame = 0.3, confidence: float = 0.95, info: bool = False, update_model: bool = True) -> TS:
    """Keep observations outside the one-step forecast's bounds.

    ``model``: a table of trained models of any kind, which the observations behind its last ticks
    are held against; or the smoothing weight of an exponential average of the observations before
    each. Bounds: the normal quantile of ``confidence`` times the root mean square of the earlier
    forecast errors. With ``update_model`` a model follows the observations; otherwise trained
    models forecast on and on from their last tick, and the average takes the mean square of all
    errors. ``info`` makes the value ``struct(value, forecast, lower, upper)``.
    """
    if isinstance(model, DataFrame):
        from .forecast import one_step_ahead

        seen = one_step_ahead(ts, model, confidence, update_model).where("is_anomaly")
        value = F.struct("value", "forecast", "lower", "upper") if info else F.col("value")
        return ts.with_df(seen.withColumn("value", value).select(*ts.keys, "tick", *ts.ord, "value"))
    smoothing = model
    z = normal_quantile(0.5 + confidence / 2)
    pred = one_step(ts, smoothing)
    df = pred.df.withColumn("_e2", F.pow(F.col("value") - F.col("forecast"), 2)).withColumn(
        "_one", F.when(F.col("forecast").isNotNull(), 1).otherwise(0).cast("long")
    )
    if update_model:
        df = ts.running({"_s": ("sum_before", "_e2"), "_k": ("sum_before", "_one")}, df)
    else:
        total = df.groupBy(*ts.keys).agg(F.sum("_e2").alias("_s"), F.sum("_one").alias("_k"))
        df = join_on(df, total, ts.keys)
    width = z * F.sqrt(F.try_divide(F.col("_s"), F.col("_k")))
    lower, upper = F.col("forecast") - width, F.col("forecast") + width
    df = df.withColumn("lower", lower).withColumn("upper", upper)
    hit = (F.col("_k") >= 2) & (F.isnan("value") | (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    value = F.struct("value", "forecast", "lower", "upper") if info else F.col("value")
    out = df.where(hit).withColumn("value", value)
    return ts.with_df(out.select(*ts.keys, "tick", *ts.ord, "value"))
