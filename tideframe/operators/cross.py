"""Aggregation across the series of a multi series."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..handle import TS, as_column
from ..plans import join_on


def aggregate(ts: TS, agg) -> DataFrame:
    """Fold all observations of all series into one row by an aggregate expression."""
    return ts.df.agg(as_column(agg).alias("value"))


def aggregate_fold(ts: TS, zero, seq_func: Callable, comb_func: Callable, value_type: str = "double", salt: int = 64, neutral=None) -> DataFrame:
    """Fold with Python functions: ``seq_func(acc, values)`` per batch, ``comb_func(acc, acc)`` between partials.

    Rows are first folded per partition, the partials per salt group, and only those meet in one task.
    ``zero`` counts once, in the last merge; partitions start from ``neutral``, by default the empty value
    of zero's type (0 of a number), which must change nothing when merged: give -inf for a maximum.
    ``comb_func`` must be associative and commutative. Without rows the result is ``zero``.
    """
    empty = type(zero)() if neutral is None else neutral

    def partial(batches):
        acc, rows = empty, 0
        for pdf in batches:
            acc, rows = seq_func(acc, pdf["value"]), rows + len(pdf)
        if rows:
            yield pd.DataFrame({"acc": [acc]})

    def merged(values):
        return pd.DataFrame({"acc": [reduce(comb_func, values)]})

    parts = ts.df.select("value").mapInPandas(partial, f"acc {value_type}")
    mixed = parts.groupBy(F.pmod(F.xxhash64("acc"), F.lit(salt)).alias("s")).applyInPandas(lambda pdf: merged(pdf["acc"]), f"acc {value_type}")
    start = ts.df.sparkSession.createDataFrame([(zero,)], f"acc {value_type}")
    return start.unionByName(mixed).groupBy().applyInPandas(lambda pdf: merged(pdf["acc"]), f"acc {value_type}").select(F.col("acc").alias("value"))


def aggregate_series(ts: TS, agg) -> TS:
    """Per tick, across keys: one series (key column ``series``) of an aggregate of ``value``."""
    out = ts.df.groupBy("tick").agg(as_column(agg).alias("value"))
    return TS(out.select(F.lit(0).alias("series"), "tick", "value"), ("series",), (), ts.trs, ts.chunk_rows)


def aggregate_series_with_key(ts: TS, agg) -> TS:
    """Per tick, across keys, with the key columns in reach of the aggregate, e.g. ``max_by(key, value)``."""
    return aggregate_series(ts, agg)


def pair_wise_transform(ts: TS, agg, pairs: DataFrame) -> DataFrame:
    """One row per pair of series: an aggregate over ``left`` and ``right`` on shared ticks.

    ``pairs`` (columns ``left_<key>``, ``right_<key>``) names the pairs to reduce, so that the work is
    chosen by the caller and does not grow with the square of the series.
    """
    left, right = [f"left_{k}" for k in ts.keys], [f"right_{k}" for k in ts.keys]
    a = ts.df.select("tick", *[F.col(k).alias(n) for k, n in zip(ts.keys, left)], F.col("value").alias("left"))
    b = ts.df.select("tick", *[F.col(k).alias(n) for k, n in zip(ts.keys, right)], F.col("value").alias("right"))
    both = join_on(join_on(a, pairs.select(*left, *right).distinct(), left), b, [*right, "tick"])
    return both.groupBy(*left, *right).agg(as_column(agg).alias("value"))
