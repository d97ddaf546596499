"""Reducers of two series: correlation, convolution, distances, causality.

``BinaryReducer.apply`` gets rows (group, tick, left, right); ``reduce2`` builds them by an inner join
on the tick.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import f_tail
from ..handle import TS, as_column
from ..plans import frame, join_on, running
from .joins import joined
from .reducers import _ddl, least_squares, moments

BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class BinaryReducer:
    """``columns()`` over ``left`` / ``right``; or ``job(df, group, rows)``; ``aligned``: rows share ticks."""

    columns: Callable[[], dict[str, Column]] | None = None
    job: Callable[[DataFrame, list[str], int], DataFrame] | None = None
    separate: Callable[[DataFrame, DataFrame, list[str], int], DataFrame] | None = None

    def apply(self, df: DataFrame, group, rows: int) -> DataFrame:
        if self.columns is not None:
            return df.groupBy(*group).agg(*[c.alias(n) for n, c in self.columns().items()])
        return self.job(df, list(group), rows)


def reduce2(left: TS, right: TS, reducer: BinaryReducer) -> DataFrame:
    """Two series to scalar(s) per key."""
    if reducer.separate is not None:
        a = left.row_index("i").select(*left.keys, "i", F.col("value").cast("double").alias("x"))
        b = right.row_index("i").select(*left.keys, "i", F.col("value").cast("double").alias("x"))
        return reducer.separate(a, b, list(left.keys), left.chunk_rows)
    both = joined(left, right, "inner")
    if reducer.columns is not None:
        return reducer.apply(both, left.keys, None)
    fits = left.bounded() and (set(right.keys) != set(left.keys) or right.bounded())
    return reducer.apply(both, left.keys, None if fits else left.chunk_rows)


def correlation() -> BinaryReducer:
    """Pearson correlation on shared ticks."""
    return BinaryReducer(columns=lambda: {"correlation": F.corr("left", "right")})


def manhattan() -> BinaryReducer:
    """Sum of absolute differences on shared ticks."""
    return BinaryReducer(columns=lambda: {"manhattan": F.sum(F.abs(F.col("left") - F.col("right")))})


def binary_expression(name: str, agg) -> BinaryReducer:
    """Any aggregate expression over ``left`` and ``right``."""
    return BinaryReducer(columns=lambda: {name: as_column(agg)})


def cross_correlation(max_lag: int) -> BinaryReducer:
    """Rows (``lag``, ``correlation``): Pearson of left[i] with right[i + lag], lag = -max_lag..max_lag."""

    def job(df, group, rows):
        lags = range(-max_lag, max_lag + 1)
        name = lambda k: f"_r{k + max_lag}"
        df = frame(
            df, group, ["tick"], lambda w: {name(k): F.lead("right", k).over(w) if k >= 0 else F.lag("right", -k).over(w) for k in lags},
            before=max_lag, after=max_lag, rows=rows,
        )
        both = lambda k: F.col("left").isNotNull() & F.col(name(k)).isNotNull()
        aggs = [F.corr(F.when(both(k), F.col("left")), F.when(both(k), F.col(name(k)))).alias(name(k)) for k in lags]
        wide = df.groupBy(*group).agg(*aggs)
        items = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(name(k)).alias("correlation")) for k in lags])
        return wide.select(*group, F.inline(items))

    return BinaryReducer(job=job)


def _blocks(df: DataFrame, group, block: int, name: str) -> DataFrame:
    """Pack rows (group, i, x) into arrays of at most ``block`` values; missing values count as 0."""
    b = F.floor(F.col("i") / block)
    packed = df.groupBy(*group, b.alias(f"_{name}b")).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("x", F.lit(0.0)).alias("x")))).alias("_a"))
    return packed.select(*group, f"_{name}b", F.transform("_a", lambda s: s["x"]).alias(f"_{name}"))


def convolution(a: DataFrame, b: DataFrame, group, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows (group, i, value) of the full convolution of two indexed series (group, i, x).

    Blocks of either side are convolved pairwise (by FFT when they are long) and the overlapping
    results added up; no pair of single values is ever a row.
    """

    @F.pandas_udf("array<double>")
    def conv(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_conv(np.asarray(p), np.asarray(q)) for p, q in zip(x, y)])

    pairs = join_on(_blocks(a, group, block, "x"), _blocks(b, group, block, "y"), group)
    part = pairs.select(*group, ((F.col("_xb") + F.col("_yb")) * block).alias("_o"), F.posexplode(conv("_x", "_y")).alias("_p", "_v"))
    return part.groupBy(*group, (F.col("_o") + F.col("_p")).alias("i")).agg(F.sum("_v").alias("value"))


def _conv(x, y):
    if min(len(x), len(y)) < 64:
        return np.convolve(x, y)
    n = len(x) + len(y) - 1
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)


def convolve() -> BinaryReducer:
    """Rows (``i``, ``value``) of the full convolution of the two value sequences."""
    return BinaryReducer(separate=lambda a, b, group, rows: convolution(a, b, group))


def sbd() -> BinaryReducer:
    """Shape-based distance ``1 - max(cross-correlation) / (|x| |y|)``, between 0 and 2."""

    def job(a, b, group, rows):
        norm = F.sqrt(F.sum(F.col("x") * F.col("x")))
        na = a.groupBy(*group).agg(norm.alias("_na"))
        nb = b.groupBy(*group).agg(norm.alias("_nb"), F.max("i").alias("_last"))
        mirrored = join_on(b, nb, group).select(*group, (F.col("_last") - F.col("i")).alias("i"), "x")
        best = convolution(a, mirrored, group).groupBy(*group).agg(F.max("value").alias("_best"))
        out = join_on(join_on(best, na, group), nb, group)
        return out.select(*group, (1 - F.try_divide("_best", F.col("_na") * F.col("_nb"))).alias("sbd"))

    return BinaryReducer(separate=job)


def mutual_information(num_bins: int | None = None) -> BinaryReducer:
    """Mutual information (natural log) of the two values, binned evenly over each series' range if asked."""

    def job(df, group, rows):
        df = df.where(F.col("left").isNotNull() & F.col("right").isNotNull())
        if num_bins is not None:
            span = df.groupBy(*group).agg(*[f(c).alias(f"_{n}_{c}") for c in ("left", "right") for n, f in (("lo", F.min), ("hi", F.max))])
            df = join_on(df, span, group)
            for c in ("left", "right"):
                lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
                b = F.floor(F.try_divide(F.col(c) - lo, hi - lo) * num_bins)
                df = df.withColumn(c, F.coalesce(F.least(b, F.lit(num_bins - 1)), F.lit(0)))
        joint = df.groupBy(*group, "left", "right").agg(F.count(F.lit(1)).alias("_c"))
        total = lambda side: F.sum("_c").over(Window.partitionBy(*group, side))
        joint = joint.withColumn("_x", total("left")).withColumn("_y", total("right"))
        # I = ln n + sum(c (ln c - ln x - ln y)) / n
        n, c = F.sum("_c"), F.col("_c")
        mi = F.ln(n) + F.sum(c * (F.ln(c) - F.ln("_x") - F.ln("_y"))) / n
        return joint.groupBy(*group).agg(mi.alias("mutual_information"))

    return BinaryReducer(job=job)


def _distance_sums(df: DataFrame, group, rows: int) -> DataFrame:
    """Squared distance covariance (``dcov2``) and both variances (``dvar2_left``, ``dvar2_right``) per group.

    |a-b| sums over all pairs are prefix sums in sorted order; the sum of products of two distances
    splits into sums over pairs ordered alike in both columns, which are collected level by level
    over halving blocks of the first column's ranks. That is n log n rows instead of n squared.
    """
    df = df.where(F.col("left").isNotNull() & F.col("right").isNotNull())
    means = df.groupBy(*group).agg(F.avg("left").alias("_ml"), F.avg("right").alias("_mr"), F.count(F.lit(1)).alias("_n"))
    base = join_on(df, means, group).select(
        *group, "tick", "_n", (F.col("left") - F.col("_ml")).alias("x"), (F.col("right") - F.col("_mr")).alias("y")
    )
    one = base.withColumn("_one", F.lit(1.0))
    # Row sums of the distance matrices.
    for c in ("x", "y"):
        one = running(one, group, [c, "tick"], {f"_c{c}": ("sum", "_one"), f"_s{c}": ("sum", c)}, rows)
        # The column is centred, so its total is zero up to rounding.
        one = one.withColumn(f"a{c}", F.col(c) * (2 * F.col(f"_c{c}") - F.col("_n")) - 2 * F.col(f"_s{c}"))
    x, y = F.col("x"), F.col("y")
    flat = one.groupBy(*group).agg(
        F.first("_n").cast("double").alias("_n"),
        F.sum("ax").alias("_ax"), F.sum("ay").alias("_ay"),
        F.sum(F.col("ax") * F.col("ay")).alias("_axy"), F.sum(F.col("ax") * F.col("ax")).alias("_axx"), F.sum(F.col("ay") * F.col("ay")).alias("_ayy"),
        F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"),
    )
    longest = means.agg(F.max("_n")).first()[0] or 1
    levels = max(1, int(longest - 1).bit_length())
    rank = one.select(*group, "x", "y", "tick", (F.col("_cx").cast("long") - 1).alias("_r"))
    rank = rank.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    # shift by a column: blocks of 2^(l+1) ranks, lower half = 0, upper half = 1
    half = F.floor(F.col("_r") / F.pow(F.lit(2.0), F.col("_l"))).cast("long")
    rank = rank.withColumn("_b", F.floor(half / 2)).withColumn("_up", half % 2)
    low = F.when(F.col("_up") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    rank = rank.withColumns({"_k1": low, "_kx": low * x, "_ky": low * y, "_kxy": low * x * y})
    sums = {f"_t{c}": ("sum", f"_k{c}") for c in ("1", "x", "y", "xy")}
    dom = running(rank, [*group, "_l", "_b"], ["y", "tick"], sums, rows).where("_up = 1")
    alike = x * y * F.col("_t1") - x * F.col("_ty") - y * F.col("_tx") + F.col("_txy")
    dom = dom.groupBy(*group).agg(F.sum(alike).alias("_d"))
    out = join_on(flat, dom, group, "left").withColumn("_d", F.coalesce("_d", F.lit(0.0)))
    n = F.col("_n")
    # Sum over ordered pairs of |dx||dy|; centred columns make sum (dx dy) over i<j equal n * sum xy.
    cross = 2 * (2 * F.col("_d") - n * F.col("_xy"))

    def v(total, row_products, sa, sb):
        return total / n**2 + F.col(sa) * F.col(sb) / n**4 - 2 * F.col(row_products) / n**3

    return out.select(
        *group,
        v(cross, "_axy", "_ax", "_ay").alias("dcov2"),
        v(2 * n * F.col("_xx"), "_axx", "_ax", "_ax").alias("dvar2_left"),
        v(2 * n * F.col("_yy"), "_ayy", "_ay", "_ay").alias("dvar2_right"),
    )


def _root(c):
    return F.sqrt(F.greatest(F.col(c), F.lit(0.0)))


def distance_covariance() -> BinaryReducer:
    """Distance covariance of Szekely, Rizzo and Bakirov (2007)."""
    return BinaryReducer(job=lambda df, g, rows: _distance_sums(df, g, rows).select(*g, _root("dcov2").alias("distance_covariance")))


def distance_variance() -> BinaryReducer:
    """Distance variance of the left values."""
    return BinaryReducer(job=lambda df, g, rows: _distance_sums(df, g, rows).select(*g, _root("dvar2_left").alias("distance_variance")))


def distance_correlation() -> BinaryReducer:
    """Distance correlation, between 0 and 1."""

    def job(df, g, rows):
        s = _distance_sums(df, g, rows)
        r = F.try_divide(F.greatest("dcov2", F.lit(0.0)), F.sqrt(F.col("dvar2_left") * F.col("dvar2_right")))
        return s.select(*g, F.sqrt(r).alias("distance_correlation"))

    return BinaryReducer(job=job)


def granger(lag: int = 1) -> BinaryReducer:
    """Do ``lag`` past left values help to predict right: ``f_statistic`` and ``p_value``."""

    def job(df, group, rows):
        means = df.groupBy(*group).agg(F.avg("left").alias("_ml"), F.avg("right").alias("_mr"))
        df = join_on(df, means, group).withColumn("left", F.col("left") - F.col("_ml")).withColumn("right", F.col("right") - F.col("_mr"))
        own, other = [f"y{k}" for k in range(1, lag + 1)], [f"x{k}" for k in range(1, lag + 1)]

        def cols(w):
            out = {"one": F.lit(1.0)}
            out.update({f"y{k}": F.lag("right", k).over(w) for k in range(1, lag + 1)})
            out.update({f"x{k}": F.lag("left", k).over(w) for k in range(1, lag + 1)})
            return out

        names = ["one", *own, *other, "right"]
        sums = moments(frame(df, group, ["tick"], cols, before=lag, rows=rows), group, names)
        y = len(names) - 1

        def solve(batches):
            for pdf in batches:
                stat, dof = [], []
                for row in pdf.to_dict("records"):
                    free = row["n"] - 2 * lag - 1
                    dof.append(free)
                    if free <= 0:
                        stat.append(np.nan)
                        continue
                    _, short, _ = least_squares(row, list(range(lag + 1)), y)
                    _, long, _ = least_squares(row, list(range(2 * lag + 1)), y)
                    stat.append((short - long) / lag / (long / free) if long > 0 else np.nan)
                out = pdf[list(group)].copy()
                out["f_statistic"] = stat
                out["p_value"] = f_tail(np.array(stat, float), lag, np.array(dof, float))
                yield out

        return sums.mapInPandas(solve, f"{_ddl(df, group)}, f_statistic double, p_value double")

    return BinaryReducer(job=job)
