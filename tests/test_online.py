"""Training that goes on, folds of states that never forget, panes, position lists, long shapes, idle streams."""

import json
import math
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideframe import TS
from tideframe.operators import cluster, elements, forecast, mining, reducers, segments, transforms, warp
from tideframe.plans import ordered


def series(spark, values, **kw):
    rows = [(k, i * 2, float(v)) for k, s in values.items() for i, v in enumerate(s)]
    return TS(spark.createDataFrame(rows, "k long, tick long, value double"), ("k",), **kw)


def waves(seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for k, n in ((1, 70), (2, 41), (3, 6)):
        t = np.arange(n)
        out[k] = 50 + 0.3 * t + 5 * np.sin(t * 2 * np.pi / 5) + np.cumsum(rng.normal(size=n)) * 0.5 + rng.normal(size=n)
    return out


FITS = {"hws": lambda t: forecast.hws(t, 5), "arma": lambda t: forecast.arma(t, 12), "arima": lambda t: forecast.arima(t, 12, difference=2)}


def facts(model):
    out = {}
    for r in model.collect():
        out[r.k] = [r.kind, r.is_initialized, r.error_history_length, r.initial_time, r.last_time, r.orders, r.params, r.state, r.sd, r.average_interval]
    return out


def close(a, b):
    if isinstance(a, list):
        return b is not None and len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, float) and b is not None:
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("kind, cuts", [("hws", (4, 40)), ("arma", (40,)), ("arima", (45,))])
def test_training_goes_on(spark, kind, cuts):
    """Trained on the first rows, then on the rest in parts, a model is the one of all rows."""
    ts = series(spark, waves())
    want = facts(FITS[kind](ts))
    model, low = None, -1
    for high in [*[2 * c for c in cuts], 10**6]:
        part = ts.with_df(ts.df.where((F.col("tick") > low) & (F.col("tick") <= high)))
        model = FITS[kind](part) if model is None else forecast.update_model(model, part)
        model, low = ordered.saved(model), high
    got = facts(model)
    assert got.keys() == want.keys()
    for k in want:
        assert close(want[k], got[k]), (k, want[k], got[k])
    assert want[1][1]
    out = forecast.predict(model, ["k"], 3).collect()
    assert sorted((r.k, r.step) for r in out) == [(k, s) for k in (1, 2, 3) for s in (1, 2, 3)]


def test_arma_is_least_squares(spark):
    rng = np.random.default_rng(1)
    v = np.zeros(300)
    for t in range(2, 300):
        v[t] = 0.6 * v[t - 1] - 0.2 * v[t - 2] + rng.normal()
    v += 1e6  # far from zero
    m = forecast.arma(series(spark, {1: v}), p_min=2, p_max=2, q_max=0).first()
    x, mean = v - v.mean(), v.mean()
    a = np.column_stack([np.ones(295), x[4:-1], x[3:-2]])
    beta = np.linalg.lstsq(a, x[5:], rcond=None)[0]
    assert np.allclose(m.params, beta, atol=1e-6) and m.state[0] == pytest.approx(mean) and np.allclose(m.state[1:], [x[-1], x[-2]], atol=1e-6)
    assert m.sd == pytest.approx(np.sqrt(np.mean((x[5:] - a @ beta) ** 2)), rel=1e-6)


def test_forced_and_unforced_arima(spark):
    walk = series(spark, {1: np.random.default_rng(2).normal(size=200).cumsum()})
    assert forecast.arima(walk).first().is_initialized
    loose = forecast.arima(walk, force_model=False).first()
    assert loose.is_initialized == (sum(loose.orders[:2]) > 0)


@pytest.mark.parametrize("kind", ["hws", "arima"])
def test_anomalies_against_a_model(spark, kind):
    """Every observation against the model that all before it made, by walking them one at a time."""
    values = waves()
    values[1][60] += 500
    ts = series(spark, {1: values[1]})
    model = FITS[kind](ts.filter("tick < 100"))
    got = {r.tick: r.value for r in transforms.detect_anomalies(ts, model, 0.95, info=True).df.collect()}
    assert 120 in got
    m = model.first()
    z, sse, n = 1.959963984540054, m.sd**2 * m.error_history_length, m.error_history_length
    from tideframe.operators import online

    state = {"kind": m.kind, "params": m.params, "orders": m.orders, "state": m.state}
    for i in range(50, 70):
        ahead = forecast._path(m.kind, m.params, m.orders, state["state"], m.sd, 1)[0][0]
        width, v = z * math.sqrt(sse / n), values[1][i]
        assert (2 * i in got) == (abs(v - ahead) > width)
        if 2 * i in got:
            assert got[2 * i].forecast == pytest.approx(ahead) and got[2 * i].upper == pytest.approx(ahead + width)
        state["state"], sse, n = online.advance(state, v), sse + (v - ahead) ** 2, n + 1
    fixed = transforms.detect_anomalies(ts, model, 0.95, update_model=False)
    assert 120 in [r.tick for r in fixed.df.collect()]


def test_a_running_sum_over_many_blocks(spark, monkeypatch):
    """A state that never forgets costs a fixed number of tables, however many blocks there are."""
    tables = []
    keep = ordered.saved
    monkeypatch.setattr(ordered, "saved", lambda df: tables.append(1) or keep(df))
    df = spark.range(400).selectExpr("id % 2 AS k", "id AS tick", "cast(id % 7 AS double) AS value").unionByName(spark.sql("SELECT 9L AS k, 1L AS tick, 5.0D AS value"))

    def step(block, state):
        total = json.loads(state) + block["value"].cumsum()
        return block[["tick"]].assign(value=total), json.dumps(float(total.iat[-1]))

    out = elements.fold_series(TS(df, ("k",), chunk_rows=20), step, "0.0", rows=20).df.toPandas().sort_values(["k", "tick"])
    want = df.toPandas().sort_values(["k", "tick"])
    want["value"] = want.groupby("k")["value"].cumsum()
    assert out[["k", "tick", "value"]].reset_index(drop=True).equals(want[["k", "tick", "value"]].reset_index(drop=True))
    assert len(tables) < 40


@pytest.mark.parametrize("by_time", [False, True])
def test_panes_equal_copied_rows(spark, by_time):
    rng = np.random.default_rng(8)
    rows = []
    for k in (1, 2, 3):
        for t in np.sort(rng.choice(3_000, 150, replace=False)).tolist():
            v = None if t % 11 == 0 else float("nan") if k == 2 and t % 37 == 0 else float(rng.normal() * 3 + 1e6)
            rows.append((k, t, v))
    ts = TS(spark.createDataFrame(rows, "k long, tick long, value double"), ("k",))
    for window, step, whole in ((20, 3, True), (200, 8, False)):
        segs = ts.segment_by_time(window * 10, step * 10) if by_time else ts.segment(window, step, enforce_size=whole)
        for name in ("sum", "max", "standard_deviation"):
            reducer = getattr(reducers, name)()
            fast = {(r.k, r.seg_id): (r.tick, r.value) for r in segments.transform(segs, reducer).df.collect()}
            slow = {(r.k, r.seg_id): (r.tick, r.value) for r in segments.transform(replace(segs, sliding=None), reducer).df.collect()}
            assert fast.keys() == slow.keys()
            for i, (tick, value) in slow.items():
                assert fast[i][0] == tick
                assert fast[i][1] == pytest.approx(value, rel=1e-6, abs=1e-6, nan_ok=True) if value is not None else fast[i][1] is None


def test_texts_have_panes_of_rows(spark):
    ts = TS(spark.createDataFrame([(1, i, "abc"[i % 3]) for i in range(9)], "k long, tick long, value string"), ("k",))
    got = segments.transform(ts.segment(4, 2), reducers.max()).df
    assert {r.value for r in got.collect()} == {"c"}


def test_position_lists_in_stretches(spark):
    rng = np.random.default_rng(6)
    rows = [(k, t, "abcd"[rng.integers(4)]) for k in range(4) for t in range(5 + 40 * (k == 1))]
    whole = TS(spark.createDataFrame(rows, "k long, tick long, value string"), ("k",))
    cut = replace(whole, chunk_rows=8)
    a, b = (sorted(map(str, mining.frequent_sub_sequences(t, 0.5, 3).collect())) for t in (whole, cut))
    assert a and a == b
    model = mining.frequent_sub_sequences(whole, 0.5, 2)
    assert sorted(mining.sub_sequence_matches(whole, model).collect()) == sorted(mining.sub_sequence_matches(cut, model).collect())


def test_long_shapes_without_product_matrices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = np.sin(np.arange(24) / 3), np.where(np.arange(24) % 12 < 6, 1.0, -1.0), np.linspace(-1, 1, 24)
    rows = [(i, [float(v) for v in np.roll(base[i % 3], i % 4) + rng.normal(size=24) * 0.1]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, values array<double>")
    dense = cluster.fit(df, 3, keys=["id"], max_iterations=2)
    monkeypatch.setattr(cluster, "DENSE_LENGTH", 4)
    long = cluster.fit(df, 3, keys=["id"], max_iterations=2)
    assert np.allclose(dense.centroids, long.centroids, atol=1e-4) and dense.sizes == long.sizes
    assert dense.sum_squares == pytest.approx(long.sum_squares, rel=1e-4)


def test_the_nearest_series(spark):
    rng = np.random.default_rng(4)
    values = {k: rng.normal(size=20 + k % 3).cumsum() for k in range(5)}
    ts = series(spark, values)
    pairs = spark.createDataFrame([(a, b) for a in values for b in values if a < b], "left_k long, right_k long")
    every = {(r.left_k, r.right_k): r.dtw for r in warp.sakoe_chiba_dtw(ts, ts, pairs, 4).collect()}
    bounds = {(r.left_k, r.right_k): r.bound for r in warp.lower_bounds(ts, ts, pairs, 4).collect()}
    assert bounds.keys() == every.keys() and all(bounds[p] <= every[p] + 1e-9 for p in every)
    for r in warp.nearest(ts, ts, pairs, 4).collect():
        assert (r.dtw, r.right_k) == (pytest.approx(min(d for (a, _), d in every.items() if a == r.left_k)), min((d, b) for (a, b), d in every.items() if a == r.left_k)[1])


def test_tiles_outside_a_band_are_not_built(spark):
    ts = series(spark, {1: np.arange(60.0), 2: np.arange(60.0)[::-1], 3: np.arange(9.0)})
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_k long, right_k long")
    got = {r.right_k: r.dtw for r in warp.sakoe_chiba_dtw(ts, ts, pairs, 3, tile=40).collect()}
    whole = {r.right_k: r.dtw for r in warp.sakoe_chiba_dtw(ts, ts, pairs, 3).collect()}
    assert got == whole and got[3] == math.inf and got[2] < math.inf


def test_idle_keys_are_forgotten(spark, tmp_path):
    from tideframe.streaming import add_sink, stream_series

    src, at = str(tmp_path / "in"), str(tmp_path / "at")
    schema, start = "k long, ts timestamp, i int, v long", datetime(2024, 1, 1)

    def more(*rows):
        spark.createDataFrame([(k, start + timedelta(minutes=m), i, v) for k, m, i, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
        live = stream_series(spark.readStream.schema(schema).parquet(src), "ts", "k", "v", "1 minute", ord="i", idle=30 * 60_000)

        def step(block, state):
            seen = json.loads(state)
            out = []
            for v in block["value"].tolist():
                seen += 1
                out.append([v, seen])
            return pd.DataFrame(out, columns=["value", "nth"]), json.dumps(seen)

        got = []
        add_sink(live.fold(step, "0", "value long, nth long"), lambda batch, _id: got.extend((r.k, r.value, r.nth) for r in batch.collect()), at).awaitTermination()
        return sorted(got)

    big = (1 << 60) + 1
    assert more((1, 0, 2, 5), (1, 0, 1, big), (2, 3, 0, 7), (2, 20, 0, 1)) == [(1, 5, 2), (1, big, 1), (2, 7, 1)]
    more((2, 60, 0, 2))
    more((2, 61, 0, 3))  # by now the first key's last row is older than the limit
    got = more((1, 90, 0, 6), (2, 100, 0, 4)) + more((2, 200, 0, 5))
    assert (1, 6, 1) in got and (2, 4, 5) in got
