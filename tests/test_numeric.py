"""Operators without check SQL against plain numpy on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions.special import chi2_tail, f_tail
from tideframe.handle import TS
from tideframe.operators import cluster, forecast, pairs, reducers, segments, transforms, warp

RNG = np.random.default_rng(5)
SERIES = {k: np.round(RNG.normal(size=n).cumsum(), 2) for k, n in ((1, 13), (2, 9), (3, 22))}


def make(spark, series=SERIES, **kw):
    rows = [(k, i * 10, float(v)) for k, s in series.items() for i, v in enumerate(s)]
    return TS(spark.createDataFrame(rows, "k long, tick long, value double"), ("k",), **kw)


@pytest.fixture(scope="module")
def ts(spark):
    return make(spark)


@pytest.fixture(scope="module")
def couples(spark):
    return spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "left_k long, right_k long")


def table_dtw(x, y, ok=lambda i, j, n, m: True):
    n, m = len(x), len(y)
    t = np.full((n + 1, m + 1), np.inf)
    t[0, 0] = 0
    for i, j in itertools.product(range(n), range(m)):
        if ok(i, j, n, m):
            t[i + 1, j + 1] = abs(x[i] - y[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t[n, m]


def parallelogram(i, j, n, m):
    u, v = i / (n - 1), j / (m - 1)
    return max(u / 2, 2 * u - 1) - 1e-9 <= v <= min(2 * u, (u + 1) / 2) + 1e-9


@pytest.mark.parametrize("tile", [5, 100])
def test_dtw_in_tiles(ts, couples, tile):
    runs = {
        "full": (warp.dtw(ts, ts, couples, tile=tile), lambda i, j, n, m: True),
        "band": (warp.sakoe_chiba_dtw(ts, ts, couples, 13, tile=tile), lambda i, j, n, m: abs(i - j) <= 13),
        "itakura": (warp.itakura_parallelogram_dtw(ts, ts, couples, tile=tile), parallelogram),
    }
    for df, ok in runs.values():
        got = {(r.left_k, r.right_k): r.dtw for r in df.collect()}
        assert len(got) == 3
        for (a, b), d in got.items():
            assert d == pytest.approx(table_dtw(SERIES[a], SERIES[b], ok))


def edit(x, y):
    n, m = len(x), len(y)
    t = np.zeros((n + 1, m + 1))
    t[:, 0], t[0, :] = np.arange(n + 1), np.arange(m + 1)
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
        if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
            t[i, j] = min(t[i, j], t[i - 2, j - 2] + 1)
    return t[n, m]


@pytest.mark.parametrize("tile", [2, 3, 50])
def test_edit_distance_in_tiles(spark, tile):
    words = {1: "abcdefgh", 2: "bacdfehg", 3: "xbadc"}
    rows = [(k, i, c) for k, w in words.items() for i, c in enumerate(w)]
    s = TS(spark.createDataFrame(rows, "k long, tick long, value string"), ("k",))
    pairs_ = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "left_k long, right_k long")
    for r in warp.damerau_levenshtein(s, s, pairs_, tile=tile).collect():
        assert r.distance == edit(words[r.left_k], words[r.right_k])


def ols(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, e @ e, np.linalg.inv(x.T @ x)


def test_adf_and_granger(spark):
    rng = np.random.default_rng(1)
    a = {1: rng.normal(size=40), 2: rng.normal(size=60).cumsum()}
    b = {k: np.concatenate([[0.0], 0.8 * v[:-1]]) + 0.1 * rng.normal(size=len(v)) for k, v in a.items()}
    got = {r.k: r for r in make(spark, a).reduce(reducers.adf(2)).collect()}
    for k, v in a.items():
        d = np.diff(v)
        x = np.column_stack([np.ones(len(d) - 2), v[2:-1], d[1:-1], d[:-2]])
        beta, sse, inv = ols(d[2:], x)
        assert got[k].statistic == pytest.approx(beta[1] / math.sqrt(sse / (len(d) - 2 - 4) * inv[1, 1]), rel=1e-6)
    assert got[1].is_stationary
    for r in make(spark, a).reduce(make(spark, b), pairs.granger(2)).collect():
        x, y = a[r.k], b[r.k]
        own = np.column_stack([np.ones(len(y) - 2), y[1:-1], y[:-2]])
        both = np.column_stack([own, x[1:-1], x[:-2]])
        (_, short, _), (_, long, _) = ols(y[2:], own), ols(y[2:], both)
        f = (short - long) / 2 / (long / (len(y) - 2 - 5))
        assert r.f_statistic == pytest.approx(f, rel=1e-6)
        assert r.p_value < 1e-6


def test_tails():
    assert chi2_tail(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert chi2_tail([0.5, 9.0], 4) == pytest.approx([math.exp(-0.25) * 1.25, math.exp(-4.5) * 5.5])
    # With two numerator degrees of freedom the tail has a closed form.
    assert f_tail([0.3, 2.5], 2, 7) == pytest.approx([(1 + 2 * x / 7) ** -3.5 for x in (0.3, 2.5)])
    assert f_tail(1.0, 9, 9) == pytest.approx(0.5)


def test_holt_winters_recovers_a_season(spark):
    season = np.array([5.0, -3.0, 1.0, -3.0])
    v = {1: np.array([10 + 0.5 * i + season[i % 4] for i in range(40)])}
    out = make(spark, v).forecast(8, "hws", samples_per_season=4).orderBy("step").collect()
    want = [10 + 0.5 * i + season[i % 4] for i in range(40, 48)]
    assert [r.tick for r in out] == [400 + 10 * i for i in range(8)]
    assert np.allclose([r.value for r in out], want, atol=0.2)


def test_arima_follows_a_line_and_arma_an_ar1(spark):
    line = {1: np.arange(40.0) * 2 + 0.01 * np.random.default_rng(0).normal(size=40)}
    out = make(spark, line).forecast(5, "arima").orderBy("step").collect()
    assert np.allclose([r.value for r in out], [80, 82, 84, 86, 88], atol=0.5)
    rng = np.random.default_rng(2)
    x = [0.0]
    for _ in range(600):
        x.append(0.7 * x[-1] + rng.normal())
    model = forecast.arma(make(spark, {1: np.array(x)}), p_min=1, p_max=1, q_max=0).first()
    assert model.params[1] == pytest.approx(0.7, abs=0.08)
    assert model.sd == pytest.approx(1.0, abs=0.1)


def test_anomaly_detector_and_nan(spark, ts):
    m = forecast.exponential(ts)
    last = {k: 10 * (len(s) - 1) for k, s in SERIES.items()}
    probes = spark.createDataFrame([(1, last[1] + 10, 1e6), (2, last[2] + 10, float("nan")), (3, last[3] + 10, float(SERIES[3][-1]))], "k long, t long, value double")
    got = {r.k: r.is_anomaly for r in forecast.is_anomaly(m, ts.keys, probes).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_regression_segments(spark):
    v = {1: np.concatenate([np.arange(10.0), 50 - 3 * np.arange(10.0)])}
    segs = segments.regression(make(spark, v), 0.5).df.groupBy("seg_id").agg(F.min("tick").alias("a"), F.max("tick").alias("z")).orderBy("a").collect()
    assert [(r.a, r.z) for r in segs] == [(0, 90), (100, 190)]


def test_kshape_tells_shapes_apart(spark):
    t = np.arange(32)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(30):
        base = np.sin(2 * np.pi * (t + rng.integers(0, 4)) / 16) if i % 2 else np.where((t + rng.integers(0, 4)) % 32 < 16, 1.0, -1.0)
        rows.append((i, [float(x) for x in base + 0.05 * rng.normal(size=32)]))
    df = spark.createDataFrame(rows, "id long, values array<double>")
    model = cluster.fit(df, 2, 3, keys=["id"])
    got = {r.id: r.cluster for r in model.score(df).collect()}
    assert len({got[i] for i in range(0, 30, 2)}) == 1
    assert len({got[i] for i in range(1, 30, 2)}) == 1
    assert got[0] != got[1]
    assert sum(model.sizes.values()) == 30


def test_noise_is_repeatable(ts):
    a = transforms.awgn(ts, 0.0, 1.0, seed=3).df.orderBy("k", "tick").collect()
    assert a == transforms.awgn(ts, 0.0, 1.0, seed=3).df.orderBy("k", "tick").collect()
    noise = [r.value - SERIES[r.k][r.tick // 10] for r in a]
    assert abs(np.mean(noise)) < 0.6 and 0.6 < np.std(noise) < 1.5


def test_edges(spark):
    schema = "k long, tick long, value double"
    empty = TS(spark.createDataFrame([], schema), ("k",))
    one = TS(spark.createDataFrame([(1, -5, 2.0)], schema), ("k",))
    tied = TS(spark.createDataFrame([(1, 3, 2.0), (1, 3, 1.0), (1, -4, None), (1, 9, float("nan"))], schema), ("k",))
    from tideframe.functions import interpolators as ip

    for s, n in ((empty, 0), (one, 1)):
        assert s.resample(2, ip.linear()).df.count() == n
        assert s.describe().count() == n
        assert s.segment_by_time(5).df.count() == n
        assert s.segment(2).df.count() == 0
        assert transforms.difference(s).df.count() == 0
    assert [r.value for r in tied.fillna(ip.next()).df.orderBy("tick", "value").collect()][0] == 1.0
    assert [r.tick for r in transforms.combine_duplicate_time_ticks(tied, "sum(value)").df.orderBy("tick").collect()] == [-4, 3, 9]
    assert tied.lag(2).df.count() == 2


def test_kshape_queries_run_whole_fits(spark, sf, monkeypatch):
    from tideframe.catalog import QUERIES

    rounds, update = [], cluster._update

    def counted(series, keys, cents, use_eigen, first_seed):
        new = update(series, keys, cents, use_eigen, first_seed)
        rounds.append((use_eigen, np.abs(new - cents).max() < 1e-6))
        return new

    monkeypatch.setattr(cluster, "_update", counted)
    for name in ("kshape_fit", "kshape_score"):
        rounds.clear()
        assert QUERIES[name](spark, sf).count() > 0
        assert all(eigen for eigen, _ in rounds)
        assert len(rounds) == 20 or rounds[-1][1]  # ends at the default limit or when nothing moves
