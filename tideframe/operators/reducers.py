"""Reducers of one series (or one segment).

A reducer works on any grouping columns, so the same object serves ``reduce`` (per series) and
``transform`` (per segment). Plain aggregates are combined map-side by Spark; the others are small
jobs of their own that never gather a long series in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.special import chi2_tail, unit_root_critical
from ..handle import TS, as_column
from ..plans import frame, is_bounded, join_on, running
from .elements import get_values


@dataclass(frozen=True)
class Reducer:
    """``columns(value, by)``: aggregate columns; or ``job(df, group, by, rows)``: a whole job.

    ``of_panes(facts)`` gives the same value from merged partial aggregates (``n``, ``sum``,
    ``squares`` about the mean, ``min``, ``max``), which spares overlapping windows their copies.
    """

    columns: Callable[[str, list[str]], dict[str, Column]] | None = None
    job: Callable[[DataFrame, list[str], list[str], int], DataFrame] | None = None
    of_panes: Callable[[dict[str, Column]], Column] | None = None

    def apply(self, df: DataFrame, group, by, rows: int) -> DataFrame:
        if self.columns is not None:
            return df.groupBy(*group).agg(*[c.alias(n) for n, c in self.columns("value", list(by)).items()])
        return self.job(df, list(group), list(by), rows)


def _simple(name: str, fn, of_panes=None) -> Reducer:
    return Reducer(columns=lambda v, by: {name: fn(F.col(v))}, of_panes=of_panes)


def average() -> Reducer:
    return _simple("average", F.avg, lambda f: F.try_divide(f["sum"], f["n"]))


def sum() -> Reducer:
    return _simple("sum", F.sum, lambda f: f["sum"])


def min() -> Reducer:
    return _simple("min", F.min, lambda f: f["min"])


def max() -> Reducer:
    return _simple("max", F.max, lambda f: f["max"])


def standard_deviation() -> Reducer:
    """Sample standard deviation."""
    return _simple("standard_deviation", F.stddev_samp, lambda f: F.when(f["n"] > 1, F.sqrt(f["squares"] / (f["n"] - 1))))


def skewness() -> Reducer:
    """Population skewness."""
    return _simple("skewness", F.skewness)


def kurtosis() -> Reducer:
    """Population excess kurtosis."""
    return _simple("kurtosis", F.kurtosis)


def expression(name: str, agg) -> Reducer:
    """Any aggregate expression."""
    return Reducer(columns=lambda v, by: {name: as_column(agg)})


def quantiles(df: DataFrame, group, wanted: dict[str, float], rows: int) -> DataFrame:
    """Exact quantiles (linear between neighbours) per group, nulls and NaN left out.

    Groups that fit a task use the built-in aggregate. Otherwise values are counted first and the
    ranks are found by a running count over the distinct values.
    """
    clean = df.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    if is_bounded(df, group, rows):
        aggs = [F.percentile("value", F.lit(q)).alias(n) for n, q in wanted.items()]
        return clean.groupBy(*group).agg(*aggs)
    counts = clean.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    cum = join_on(running(counts, group, ["value"], {"_cum": ("sum", "_c")}, rows), totals, group)
    aggs = {}
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        aggs[f"{name}_lo"] = F.min(F.when(F.col("_cum") > F.floor(at), F.col("value")))
        aggs[f"{name}_hi"] = F.min(F.when(F.col("_cum") > F.ceil(at), F.col("value")))
        aggs[f"{name}_w"] = F.first(at - F.floor(at))
    picked = cum.groupBy(*group).agg(*[c.alias(f"_{n}") for n, c in aggs.items()])
    value = {n: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w") for n in wanted}
    return picked.select(*group, *[c.alias(n) for n, c in value.items()])


def percentile(quantile: float) -> Reducer:
    """Exact quantile, linear between neighbours."""
    return Reducer(job=lambda df, g, by, rows: quantiles(df, g, {"percentile": quantile}, rows))


def _value_counts(df, group) -> DataFrame:
    return df.where(F.col("value").isNotNull()).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("count"))


def count_by_value() -> Reducer:
    """A row per (group, value) with its ``count``."""
    return Reducer(job=lambda df, g, by, rows: _value_counts(df, g))


def entropy() -> Reducer:
    """Shannon entropy (natural log) of the value distribution."""

    def job(df, group, by, rows):
        n, c = F.sum("count"), F.col("count")
        # -sum(p ln p) = ln(n) - sum(c ln c) / n
        return _value_counts(df, group).groupBy(*group).agg((F.ln(n) - F.sum(c * F.ln(c)) / n).alias("entropy"))

    return Reducer(job=job)


def histogram(min: float, max: float, num_divisions: int, normalize: bool = False) -> Reducer:
    """A row per non-empty bin; bins are half-open and the last one is closed. Values outside are left out."""

    def job(df, group, by, rows):
        v = F.col("value")
        width = (max - min) / num_divisions
        b = F.least(F.lit(num_divisions - 1), F.floor((v - min) / width)).cast("int")
        inside = df.where((v >= min) & (v <= max)).withColumn("bin", b)
        out = inside.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("count"))
        if normalize:
            total = out.groupBy(*group).agg(F.sum("count").alias("_n"))
            out = join_on(out, total, group).withColumn("count", F.col("count") / F.col("_n")).drop("_n")
        return out.withColumn("bin_start", F.lit(float(min)) + F.col("bin") * width)

    return Reducer(job=job)


QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def _summary(df: DataFrame, group, by, rows, numeric: bool) -> DataFrame:
    """One pass for everything that follows the order or is a plain aggregate, one for the value counts."""
    gaps = frame(df, group, by, lambda w: {"_gap": F.col("tick") - F.lag("tick").over(w)}, before=1, rows=rows)
    pos, n, v = F.struct(*by), F.count(F.lit(1)), F.col("value")
    aggs = {
        "count": n,
        "first": F.min_by("value", pos),
        "last": F.max_by("value", pos),
        "min_inter_arrival_time": F.min("_gap"),
        "max_inter_arrival_time": F.max("_gap"),
        "mean_inter_arrival_time": F.try_divide((F.max("tick") - F.min("tick")).cast("double"), n - 1),
    }
    fits = True
    if numeric:
        aggs.update({"mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)})
        fits = is_bounded(df, group, rows)
        if fits:
            clean = F.when(~F.isnan(v.cast("double")), v)
            aggs.update({name: F.percentile(clean, F.lit(q)) for name, q in QUARTILES.items()})
    out = gaps.groupBy(*group).agg(*[c.alias(name) for name, c in aggs.items()])
    per_value = _value_counts(df, group).groupBy(*group).agg(
        F.min_by("value", F.struct(-F.col("count"), "value")).alias("top"),
        F.max("count").alias("frequency"),
        F.count(F.lit(1)).alias("unique"),
    )
    out = join_on(out, per_value, group, "left")
    if not fits:
        out = join_on(out, quantiles(df, group, QUARTILES, rows), group, "left")
    tail = QUARTILES if numeric else ()
    return out.select(*[c for c in out.columns if c not in tail], *[F.col(f"`{c}`") for c in tail])


def describe() -> Reducer:
    """count, first, last, top, frequency, unique, inter-arrival times; for numbers also mean, std, min, max, quartiles."""

    def job(df, group, by, rows):
        return _summary(df, group, by, rows, isinstance(df.schema["value"].dataType, NumericType))

    return Reducer(job=job)


def auto_correlation(max_lag: int = 1) -> Reducer:
    """``auto_correlation``: array of the coefficients of lags 1..max_lag (lagged products over the total sum of squares)."""

    def job(df, group, by, rows):
        sums = lagged_products(df, group, by, max_lag, rows)
        coef = [F.try_divide(F.col(f"_p{k}"), F.col("_p0")) for k in range(1, max_lag + 1)]
        return sums.select(*group, F.array(*coef).alias("auto_correlation"))

    return Reducer(job=job)


def lagged_products(df, group, by, max_lag, rows) -> DataFrame:
    """Per group: ``_n`` and ``_p0.._pK``, the sums of centred values times their k-lagged ones."""
    clean = df.where(F.col("value").isNotNull())
    mean = clean.groupBy(*group).agg(F.avg("value").alias("_mean"))
    centred = join_on(clean, mean, group).withColumn("_d", F.col("value") - F.col("_mean"))
    lags = frame(
        centred, group, by, lambda w: {f"_d{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)}, before=max_lag, rows=rows
    )
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_p0")]
    aggs += [F.coalesce(F.sum(F.col("_d") * F.col(f"_d{k}")), F.lit(0.0)).alias(f"_p{k}") for k in range(1, max_lag + 1)]
    return lags.groupBy(*group).agg(*aggs)


def ljung_box(num_lags: int) -> Reducer:
    """Ljung-Box statistic ``q`` of the first ``num_lags`` autocorrelations and its ``p_value``."""

    def job(df, group, by, rows):
        n = F.col("_n")
        q = F.lit(0.0)
        for k in range(1, num_lags + 1):
            r = F.try_divide(F.col(f"_p{k}"), F.col("_p0"))
            q = q + F.try_divide(r * r, n - k)
        out = lagged_products(df, group, by, num_lags, rows).select(*group, (n * (n + 2) * q).alias("q"))

        @F.pandas_udf("double")
        def tail(s: pd.Series) -> pd.Series:
            return pd.Series(chi2_tail(s.to_numpy(float), num_lags))

        return out.withColumn("p_value", tail("q"))

    return Reducer(job=job)


def moments(df: DataFrame, group, names: list[str]) -> DataFrame:
    """Cross-product sums ``m_i_j`` (i <= j) of the columns ``names`` per group, over complete rows."""
    full = df.dropna(subset=names)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            aggs.append(F.sum(F.col(a).cast("double") * F.col(names[j]).cast("double")).alias(f"m_{i}_{j}"))
    return full.groupBy(*group).agg(*aggs)


def least_squares(row, xs: list[int], y: int):
    """Coefficients, residual sum of squares and inverse normal matrix from a row of ``moments``."""
    get = lambda i, j: row[f"m_{i}_{j}"] if i <= j else row[f"m_{j}_{i}"]
    a = np.array([[get(i, j) for j in xs] for i in xs], float)
    b = np.array([get(i, y) for i in xs], float)
    try:
        inv = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(a)
    beta = inv @ b
    return beta, float(get(y, y) - beta @ b), inv


def adf(lag: int = 1, p_value: float = 0.05) -> Reducer:
    """Augmented Dickey-Fuller test with a constant: ``statistic``, ``critical_value``, ``is_stationary``."""

    def job(df, group, by, rows):
        clean = df.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
        mean = clean.groupBy(*group).agg(F.avg("value").alias("_mean"))
        # Centring changes neither slope nor statistic and keeps the sums small.
        clean = join_on(clean, mean, group).withColumn("value", F.col("value") - F.col("_mean"))
        names = ["one", "level", *[f"d{k}" for k in range(1, lag + 1)], "d0"]

        def cols(w):
            v = lambda k: F.col("value") if k == 0 else F.lag("value", k).over(w)
            out = {"one": F.lit(1.0), "level": v(1)}
            out.update({f"d{k}": v(k) - v(k + 1) for k in range(lag + 1)})
            return out

        sums = moments(frame(clean, group, by, cols, before=lag + 1, rows=rows), group, names)
        y, xs = len(names) - 1, list(range(len(names) - 1))

        def solve(batches):
            for pdf in batches:
                stat, crit = [], []
                for row in pdf.to_dict("records"):
                    dof = row["n"] - len(xs)
                    s = np.nan
                    if dof > 0:
                        beta, sse, inv = least_squares(row, xs, y)
                        var = sse / dof * inv[1, 1]
                        s = beta[1] / np.sqrt(var) if var > 0 else np.nan
                    stat.append(s)
                    crit.append(float(unit_root_critical(p_value, row["n"])))
                out = pdf[list(group)].copy()
                out["statistic"], out["critical_value"] = stat, crit
                out["is_stationary"] = out["statistic"] < out["critical_value"]
                yield out

        ddl = _ddl(df, group)
        return sums.mapInPandas(solve, f"{ddl}, statistic double, critical_value double, is_stationary boolean")

    return Reducer(job=job)


def _ddl(df: DataFrame, cols) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def fft() -> Reducer:
    """Discrete Fourier transform of the mean-free values: rows (``k``, ``re``, ``im``) for k = 0..n/2."""
    from .spectrum import transform

    return Reducer(job=lambda df, g, by, rows: transform(df, g, by, rows))


def reduce(ts: TS, reducer: Reducer) -> DataFrame:
    """Series to scalar(s): a row per key (per key and item for reducers that say so)."""
    rows = None if reducer.columns is not None else ts.rows()  # plain aggregates need no size check
    return reducer.apply(ts.df, ts.keys, ts.by, rows)


def reduce_range(ts: TS, reducer: Reducer, start: int, end: int) -> DataFrame:
    """Reduce the observations with ``start <= tick <= end``."""
    part = get_values(ts, start, end)
    return reducer.apply(part.df, ts.keys, ts.by, part.rows())
