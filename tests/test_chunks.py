"""A series cut into chunks gives the same result as a whole one."""

import math
import os
from dataclasses import replace
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.catalog.base import DAY, HOUR, events
from tideframe.functions import interpolators as ip
from tideframe.handle import TS
from tideframe.operators import fill, joins, matchers, pairs, reducers, transforms


def small(ts: TS) -> TS:
    return replace(ts, chunk_rows=25, known_max=None)


@pytest.fixture(scope="module")
def hot(spark, sf):
    """Two thirds of the rows under one key, the rest spread, with some ticks shared by many rows."""
    ts = events(spark, sf)
    df = ts.df.where("event_id < 300").withColumn("user_id", F.when(F.col("event_id") % 3 > 0, F.lit(0)).otherwise(F.col("user_id")))
    df = df.withColumn("tick", F.when(F.col("event_id").between(100, 200), F.lit(1704067200000 + 3 * DAY)).otherwise(F.col("tick")))
    return ts.with_df(df.cache(), fewer=False)


def rows(df):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.8g}"
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return str(v)

    return sorted(tuple(norm(v) for v in r) for r in df.collect())


def gappy(ts):
    return ts.map(F.when(F.col("event_id") % 3 != 1, F.col("value")))


CASES = {
    "map_with_index": lambda t: t.map_with_index("rn * 1.0").to_df_observations(),
    "shift": lambda t: t.shift(3).to_df_observations(),
    "shift_back": lambda t: t.shift(-12, 0.0).to_df_observations(),
    "lag": lambda t: t.lag(20).to_df_observations(),
    "fill_prev": lambda t: gappy(t).fillna(ip.prev()).to_df_observations(),
    "fill_next": lambda t: gappy(t).fillna(ip.next()).to_df_observations(),
    "fill_linear": lambda t: gappy(t).fillna(ip.linear(0.0)).to_df_observations(),
    "fill_cubic": lambda t: gappy(t).fillna(ip.cubic(0.0)).to_df_observations(),
    "resample_nearest": lambda t: t.resample(DAY // 4, ip.nearest()).to_df_observations(),
    "resample_next": lambda t: t.resample(DAY // 4, ip.next()).to_df_observations(),
    "floor": lambda t: fill.floor(t, t.df.select("user_id", (F.col("tick") + 5).alias("t"))),
    "higher": lambda t: fill.higher(t, t.df.select("user_id", F.col("tick").alias("t"))),
    "as_of": lambda t: joins.joined(t.filter("event_id % 2 = 0"), t.filter("event_id % 2 = 1"), "left", None, ip.prev()).drop("right"),
    "segment": lambda t: t.segment(5, 3).bounds(),
    "panes": lambda t: t.segment(40, 3).transform(reducers.standard_deviation()).to_df_observations(),
    "panes_by_time": lambda t: t.segment_by_time(3 * DAY, 7 * HOUR).transform(reducers.average()).to_df_observations(),
    "changepoint": lambda t: t.segment_by_changepoint("abs(value - prev) > 40").bounds(),
    "marker": lambda t: t.segment_by_marker("value > 100", "value < 10").bounds(),
    "static_threshold": lambda t: t.to_segments("static_threshold", threshold=HOUR).bounds(),
    "dynamic_threshold": lambda t: t.to_segments("dynamic_threshold", alpha=0.3, factor=1.2, threshold=HOUR).bounds(),
    "cusum": lambda t: t.to_segments("cusum", threshold=150.0).bounds(),
    "regression": lambda t: t.to_segments("regression", max_error=40.0, skip=1).bounds(),
    "statistical_changepoint": lambda t: t.to_segments("statistical_changepoint", threshold=1.5).bounds(),
    "describe": lambda t: t.describe(),
    "percentile": lambda t: t.reduce(reducers.percentile(0.37)),
    "auto_correlation": lambda t: t.reduce(reducers.auto_correlation(3)),
    "adf": lambda t: t.reduce(reducers.adf(2)),
    "ljung_box": lambda t: t.reduce(reducers.ljung_box(3)),
    "difference": lambda t: transforms.difference(t).to_df_observations(),
    "ema": lambda t: transforms.ema(t, 0.2).to_df_observations(),
    "decompose": lambda t: transforms.decompose(t, 4).df.select("user_id", "tick", "value.*"),
    "anomalies": lambda t: transforms.detect_anomalies(t, info=True).df.select("user_id", "tick", "value.*"),
    "no_repeats": lambda t: transforms.remove_consecutive_duplicate_values(t.map("floor(value / 50)")).to_df_observations(),
    "sublist": lambda t: matchers.sublist().matches(t.map("if(value > 50, 'h', 'l')"), ["h", "l", "h", "h"]),
    "subseq": lambda t: matchers.subseq().matches(t.map("if(value > 100, 'h', 'l')"), ["h", "l", "h", "h", "h"]),
    "fft": lambda t: t.reduce(reducers.fft()).select("user_id", "k", F.round("re", 5).alias("re"), F.round("im", 5).alias("im")).where("k > 0"),
}


# All of them take some ten minutes: ALL_CHUNK_CASES=1 pytest tests/test_chunks.py
ALL = bool(os.environ.get("ALL_CHUNK_CASES"))
FEW = ["fill_linear", "floor", "marker", "cusum", "panes", "panes_by_time", "percentile", "ema", "subseq", "fft"]


@pytest.mark.parametrize("name", CASES if ALL else FEW)
def test_chunked_equals_whole(hot, name):
    whole = rows(CASES[name](hot))
    assert whole
    cut = rows(CASES[name](small(hot)))
    if name == "fft":
        assert len(whole) == len(cut)
        a, b = (np.array([[float(x) for x in r[2:]] for r in sorted(s, key=lambda r: (int(r[0]), int(r[1])))]) for s in (whole, cut))
        assert np.allclose(a, b, atol=1e-4)
    else:
        assert cut == whole


BINARY = {
    "cross_correlation": lambda a, b: a.reduce(b, pairs.cross_correlation(3)),
    "distance_correlation": lambda a, b: a.reduce(b, pairs.distance_correlation()),
    "granger": lambda a, b: a.reduce(b, pairs.granger(2)),
    "sbd": lambda a, b: a.reduce(b, pairs.sbd()),
    "full_interp": lambda a, b: joins.joined(a.filter("event_id % 2 = 0"), b.filter("event_id % 5 = 0"), "full", ip.linear(), ip.linear()),
}


@pytest.mark.parametrize("name", BINARY if ALL else ["sbd"])
def test_chunked_pairs(hot, name):
    one = transforms.combine_duplicate_time_ticks(hot, "max(value)") if name != "full_interp" else hot.filter("event_id NOT BETWEEN 100 AND 200")
    two = one.map("value * value - tick % 1000")
    whole = rows(BINARY[name](one, two))
    assert whole
    assert rows(BINARY[name](small(one), small(two))) == whole


@pytest.mark.parametrize("case", ["1e-6", "1", "1e12", "outliers", "one value and tails", "text", "tied ticks", "nulls and nan", "nanoseconds", "2 to the 60", "decimals", "microseconds"])
def test_chunks_fit_and_keep_the_order(spark, case):
    """Whatever the scale of the order columns, chunks hold about ``rows`` rows and follow the order."""
    from tideframe.plans import ordered

    rng = np.random.default_rng(4)
    n, size = 4_000, 100
    value = {
        "1e-6": lambda: 5 + rng.normal(size=n) * 1e-6, "1": lambda: rng.normal(size=n), "1e12": lambda: rng.normal(size=n) * 1e12,
        "outliers": lambda: np.r_[1e300, -1e300, np.exp(rng.normal(size=n - 2) * 20)], "one value and tails": lambda: np.where(rng.random(n) < 0.99, 3.0, rng.normal(size=n)),
    }
    if case in value:
        by, kind = ["a", "b"], "double"
        data = [(1, float(v), i) for i, v in enumerate(value[case]())]
    elif case in ("nanoseconds", "2 to the 60", "decimals", "microseconds"):
        # Neighbours that are equal as doubles; the second column falls, so it must not decide between them.
        by, kind = ["a", "b"], {"decimals": "decimal(38,3)", "microseconds": "timestamp"}.get(case, "long")
        base = {"nanoseconds": 1_700_000_000_000_000_000, "2 to the 60": 1 << 60, "decimals": 10**30, "microseconds": 0}[case]
        to = {"decimals": Decimal, "microseconds": lambda v: datetime(2800, 1, 1) + timedelta(microseconds=v)}.get(case, int)
        data = [(1, to(base + int(i)), n - int(i)) for i in rng.permutation(n)]
    elif case == "nulls and nan":
        by, kind = ["a", "b"], "double"
        data = [(1, [None, float("nan"), float("inf"), float(-i)][i % 4], i) for i in range(n)]
    else:
        by, kind = ["a", "b"], "string"
        data = [(1, "same prefix of many letters " + ("" if case == "tied ticks" else f"{rng.integers(1 << 40):013d}"), i) for i in range(n)]
    data += [(2, data[0][1], i) for i in range(50)]
    df = spark.createDataFrame(data, f"k int, a {kind}, b int")
    cut, chunks = ordered.add_chunk(df, ["k"], by, size)
    assert chunks and cut.count() == len(data)
    got = cut.where("k = 1").groupBy("_chunk").agg(F.count("*").alias("n"), F.min(F.struct(*by)).alias("lo"), F.max(F.struct(*by)).alias("hi")).orderBy("_chunk").collect()
    assert max(r.n for r in got) <= 2 * size and len(got) >= n // (2 * size)
    ordered_rows = [tuple(r) for r in cut.where("k = 1").orderBy("_chunk", *by).select("b").collect()]
    assert ordered_rows == [tuple(r) for r in df.where("k = 1").orderBy(*by).select("b").collect()]
