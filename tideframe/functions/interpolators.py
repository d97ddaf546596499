"""Interpolators: how a missing value is made from the observations around it.

An interpolator is a description; ``operators.fill`` gathers the observations it asks for and calls
``expr``. Missing means null (NaN is a value). Only observations of the same series are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interpolator:
    """``expr(tick, history, future)``: arrays of (tick, value), nearest last / first."""

    expr: Callable[[Column, Column, Column], Column]
    history_size: int = 1
    future_size: int = 1


def _lit(value) -> Column:
    return F.lit(value)


def fill(value) -> Interpolator:
    """A constant."""
    return Interpolator(lambda t, h, f: _lit(value), 0, 0)


def nullify() -> Interpolator:
    """Null."""
    return Interpolator(lambda t, h, f: _lit(None), 0, 0)


def prev(default_value=None) -> Interpolator:
    """Value of the observation before."""
    return Interpolator(lambda t, h, f: F.coalesce(F.try_element_at(h, F.lit(-1))["value"], _lit(default_value)), 1, 0)


def next(default_value=None) -> Interpolator:
    """Value of the observation after."""
    return Interpolator(lambda t, h, f: F.coalesce(F.try_element_at(f, F.lit(1))["value"], _lit(default_value)), 0, 1)


def nearest(default_value=None) -> Interpolator:
    """Value of the closer neighbour; the one before on a tie."""

    def expr(t, h, f):
        p, n = F.try_element_at(h, F.lit(-1)), F.try_element_at(f, F.lit(1))
        use_prev = n.isNull() | (t - p["tick"] <= n["tick"] - t)
        return F.coalesce(F.when(p.isNotNull() & use_prev, p["value"]).otherwise(n["value"]), _lit(default_value))

    return Interpolator(expr)


def linear(fill_value=None, history_size=1, future_size=1) -> Interpolator:
    """Line through the neighbours; least squares when more than one per side is asked for.

    Outside the first or last observation the result is ``fill_value``.
    """

    def two(t, h, f):
        p, n = F.try_element_at(h, F.lit(-1)), F.try_element_at(f, F.lit(1))
        slope = F.try_divide(n["value"] - p["value"], n["tick"] - p["tick"])
        line = p["value"] + F.coalesce(slope, F.lit(0.0)) * (t - p["tick"])  # neighbours may share a tick
        return F.coalesce(F.when(p.isNotNull() & n.isNotNull(), line), _lit(fill_value))

    def least_squares(t, h, f):
        pts = F.concat(h, f)
        n = F.size(pts).cast("double")

        def total(fn):
            return F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + fn((p["tick"] - t).cast("double"), p["value"].cast("double")))

        sx, sy = total(lambda x, y: x), total(lambda x, y: y)
        sxx, sxy = total(lambda x, y: x * x), total(lambda x, y: x * y)
        # Ticks are taken relative to t, so the line's value at t is its intercept.
        at_t = F.try_divide(sxx * sy - sx * sxy, n * sxx - sx * sx)
        both = (F.size(h) > 0) & (F.size(f) > 0)
        return F.coalesce(F.when(both, at_t), _lit(fill_value))

    simple = history_size == 1 and future_size == 1
    return Interpolator(two if simple else least_squares, history_size, future_size)


def cubic(fill_value=None, history_size=1, future_size=1) -> Interpolator:
    """Polynomial through two observations on either side; of lower degree where there are fewer.

    Larger sizes use more points. Outside the first or last observation the result is ``fill_value``.
    """

    def expr(t, h, f):
        pts = F.concat(h, f)

        def term(p, i):
            others = F.filter(pts, lambda _q, j: j != i)
            weight = F.aggregate(
                others,
                F.lit(1.0),
                lambda acc, q: acc * F.try_divide((t - q["tick"]).cast("double"), (p["tick"] - q["tick"]).cast("double")),
            )
            return p["value"] * weight

        poly = F.aggregate(F.transform(pts, term), F.lit(0.0), lambda acc, x: acc + x)
        return F.coalesce(F.when((F.size(h) > 0) & (F.size(f) > 0), poly), _lit(fill_value))

    return Interpolator(expr, max(2, history_size), max(2, future_size))


def custom(fn: Callable, history_size=1, future_size=1) -> Interpolator:
    """User function of (tick, history, future) pandas Series; history/future hold lists of (tick, value)."""
    from pyspark.sql.functions import pandas_udf

    run = pandas_udf(fn, "double")

    def expr(t, h, f):
        pair = lambda s: F.array(s["tick"].cast("double"), s["value"].cast("double"))
        return run(t, F.transform(h, pair), F.transform(f, pair))

    return Interpolator(expr, history_size, future_size)
