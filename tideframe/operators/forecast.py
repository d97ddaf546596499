"""Forecasting: one Spark job fits every series, and a model is a table with one row per key.

A model table has the key columns and ``kind``, ``params`` (doubles), ``state`` (doubles), ``sd`` (root
mean square of the one-step errors), ``error_history_length``, ``average_interval``, ``initial_time``,
``last_time``, ``is_initialized``. ``state`` is laid out per kind:

* ``hws_add`` / ``hws_mul``  level, trend, then the season's terms from the next phase on
* ``arma``                    constant, the last values (newest first), the last errors (newest first)

``memory`` is what training goes on from when there are new observations (``update_model``): every
weight triple's state and error for Holt-Winters, cross products of lagged values and the last values
for ARMA. It has a fixed size per key, however long the history is.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_quantile
from ..handle import TS
from ..plans import fold, join_on, saved
from .online import tested
from .reducers import _ddl

MODEL_FIELDS = (
    "kind string, params array<double>, orders array<int>, state array<double>, sd double, error_history_length long, "
    "average_interval double, initial_time long, last_time long, is_initialized boolean"
)
_NAMES = [f.split(" ")[0] for f in MODEL_FIELDS.split(", ")]
#: The fields of a model that can be trained on.
TRAINED_FIELDS = MODEL_FIELDS + ", memory string"
_TRAINED = [*_NAMES, "memory"]


def _facts(ts: TS) -> DataFrame:
    """Per key: average interval and the first and last tick of the training data."""
    n = F.count(F.lit(1))
    return ts.df.groupBy(*ts.keys).agg(
        n.alias("n"),
        F.try_divide((F.max("tick") - F.min("tick")).cast("double"), n - 1).alias("average_interval"),
        F.min("tick").alias("initial_time"),
        F.max("tick").alias("last_time"),
    )


def _clean(ts: TS, start_training_time: int | None = None) -> TS:
    df = ts.df.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    if start_training_time is not None:
        df = df.where(F.col("tick") >= start_training_time)
    return ts.with_df(df.withColumn("value", F.col("value").cast("double")))


# Holt-Winters ---------------------------------------------------------------------------------

# Smoothing weights tried per series: all triples (level, trend, season) of these.
GRID = (0.1, 0.3, 0.5, 0.7)


def _hws_start(seasons: np.ndarray, m: int, multiplicative: bool):
    """Level, trend and season terms from the first full seasons."""
    means = seasons.reshape(-1, m).mean(axis=1)
    level = means[0]
    trend = (means[-1] - means[0]) / (m * (len(means) - 1)) if len(means) > 1 else 0.0
    shape = seasons.reshape(-1, m)
    if multiplicative:
        season = (shape / means[:, None]).mean(axis=0)
    else:
        season = (shape - means[:, None]).mean(axis=0)
    return float(level), float(trend), season


def _hws_step(pdf: pd.DataFrame, text: str) -> tuple[pd.DataFrame, str]:
    """One block of observations through all weight triples side by side; resumable."""
    state = json.loads(text)
    m, k, multiplicative, seed, at, phase = (state[n] for n in ("m", "k", "multiplicative", "seed", "at", "phase"))
    grid = np.array(list(itertools.product(GRID, GRID, GRID)))
    a, b, g = grid[:, 0], grid[:, 1], grid[:, 2]
    sse, used = np.zeros(len(grid)), 0
    if at is not None:
        level, trend, season = (np.array(v) for v in at)
    for v in pdf["value"].tolist():
        if at is None:
            seed.append(v)
            if len(seed) == m * k:
                l0, t0, s0 = _hws_start(np.array(seed), m, multiplicative)
                # The level stands at the end of the training seasons.
                level = np.full(len(grid), l0 + t0 * (m * k - (m + 1) / 2))
                trend, season = np.full(len(grid), t0), np.tile(s0, (len(grid), 1))
                at, seed = True, []
            continue
        s = season[:, phase].copy()
        pred = (level + trend) * s if multiplicative else level + trend + s
        sse += (v - pred) ** 2
        used += 1
        old = level
        if multiplicative:
            base = np.where(s == 0, np.nan, s)
            level = a * (v / base) + (1 - a) * (level + trend)
            fresh = v / np.where(level == 0, np.nan, level)
        else:
            level = a * (v - s) + (1 - a) * (level + trend)
            fresh = v - level
        trend = b * (level - old) + (1 - b) * trend
        season[:, phase] = g * fresh + (1 - g) * s
        phase = (phase + 1) % m
    if at is not None:
        # Twelve digits: states that agree to rounding count as equal, so blocks settle.
        at = [[float(f"{x:.12g}") for x in level], [float(f"{x:.12g}") for x in trend], [[float(f"{x:.12g}") for x in r] for r in season]]
    text = json.dumps(state | {"seed": seed, "at": at, "phase": phase})
    out = {"tick": [int(pdf["tick"].iloc[-1])], "sse": [sse.tolist()], "used": [used], "rows": [len(pdf)], "text": [text]}
    return pd.DataFrame(out), text


def _hws_choice(r: dict) -> list:
    """Model fields from the facts of a key: errors of all triples so far, state, counts, ticks."""
    state = json.loads(r["text"])
    kind, m = "hws_mul" if state["multiplicative"] else "hws_add", state["m"]
    sse, used = np.array(list(r["sse"]), float), int(r["used"])
    memory = json.dumps({"state": r["text"], "sse": sse.tolist(), "used": used, "rows": int(r["rows"])})
    step = (r["last_time"] - r["initial_time"]) / (r["rows"] - 1) if r["rows"] > 1 else None
    facts = [step, r["initial_time"], r["last_time"]]
    if state["at"] is None or not used or np.isnan(sse).all():
        return [kind, None, [m], None, None, used, *facts, False, memory]
    i = int(np.nanargmin(sse))
    level, trend, season = state["at"]
    s, p = season[i], state["phase"]
    weights = list(itertools.product(GRID, GRID, GRID))[i]
    return [kind, list(weights), [m], [level[i], trend[i], *s[p:], *s[:p]], math.sqrt(sse[i] / used), used, *facts, True, memory]


def _models(table: DataFrame, keys, fields) -> DataFrame:
    """A model table from a row of facts per key; ``fields(row)`` gives the values of ``TRAINED_FIELDS``."""

    def work(batches):
        for pdf in batches:
            res = pd.DataFrame([fields(r) for r in pdf.to_dict("records")], columns=_TRAINED)
            for c in keys:
                res[c] = pdf[c].to_numpy()
            yield res[[*keys, *_TRAINED]]

    return table.mapInPandas(work, f"{_ddl(table, keys)}, {TRAINED_FIELDS}")


def _hws_sums(ts: TS, init: str, rows: int, start: DataFrame | None = None) -> DataFrame:
    """Per key: errors of all triples, counts, last state, first and last tick of the observations of ``ts``."""
    n = len(GRID) ** 3
    schema = "tick long, sse array<double>, used long, rows long, text string"
    parts = fold(ts.df, ts.keys, ts.by, [*ts.by, "value"], _hws_step, init, schema, min(rows, ts.chunk_rows), start)
    total = parts.groupBy(*ts.keys).agg(
        F.array(*[F.sum(F.col("sse")[i]) for i in range(n)]).alias("sse"), F.sum("used").alias("used"), F.sum("rows").alias("rows"),
        F.max_by("text", "tick").alias("text"),
    )
    return join_on(total, _facts(ts).select(*ts.keys, "initial_time", "last_time"), ts.keys)


def hws(
    ts: TS, samples_per_season: int, initial_training_seasons: int = 2, multiplicative: bool = False, start_training_time: int | None = None, rows: int = 50_000
) -> DataFrame:
    """Holt-Winters with the smoothing weights that give the least one-step squared error.

    The first ``initial_training_seasons`` seasons set the start values; series without one more
    observation than that are not initialised. All weight triples of ``GRID`` are run side by side.
    """
    ts = _clean(ts, start_training_time)
    spec = {"m": samples_per_season, "k": initial_training_seasons, "multiplicative": multiplicative}
    return _models(_hws_sums(ts, json.dumps(spec | {"seed": [], "at": None, "phase": 0}), rows), list(ts.keys), _hws_choice)


def _hws_more(model: DataFrame, ts: TS, rows: int = 50_000) -> DataFrame:
    """Holt-Winters models after the observations of ``ts``: all triples go on from where they stood."""
    keys = list(ts.keys)
    start = model.select(*keys, F.get_json_object("memory", "$.state").alias("_init"))
    more = _hws_sums(ts, "", rows, start).drop("initial_time")
    old = model.select(*keys, "initial_time", F.col("memory").alias("_old"))

    def fields(r):
        old = json.loads(r["_old"])
        sums = {"sse": np.array(old["sse"], float) + np.array(list(r["sse"]), float), "used": old["used"] + r["used"], "rows": old["rows"] + r["rows"]}
        return _hws_choice(r | sums)

    return _models(join_on(more, old, keys), keys, fields)


# ARMA / ARIMA ----------------------------------------------------------------------------------


def _lags(ts: TS, df: DataFrame, col: str, name: str, n: int) -> DataFrame:
    return ts.frame(lambda w: {f"{name}{k}": F.lag(col, k).over(w) for k in range(1, n + 1)}, before=n, df=df)


def _arma_lags(spec: dict) -> tuple[int, int]:
    """Lags of the long autoregression, and of all values that its errors' lags reach."""
    longest = max(spec["p_max"], spec["q_max"]) + 3
    return longest, longest + spec["q_max"]


def _arma_sums(ts: TS, shift: DataFrame, spec: dict, before: DataFrame | None = None) -> DataFrame:
    """Cross products of the values less ``_shift`` and their lags, and the last values, per key.

    ``m2`` sums over rows that have all lags, ``m1`` over those that only have the lags of the long
    autoregression (the first few of a series). ``before``: values that lie before those of ``ts``
    (columns of ``ts`` and ``_new`` false), which give lags but are not summed.
    """
    keys = list(ts.keys)
    longest, most = _arma_lags(spec)
    df = ts.df.withColumn("_new", F.lit(True))
    if before is not None:
        df = df.unionByName(before)
    df = join_on(df, shift, keys).withColumn("x0", F.col("value") - F.col("_shift"))
    df = _lags(ts.with_df(df, fewer=False), df, "x0", "x", most)
    columns = [F.lit(1.0), *[F.col(f"x{k}") for k in range(most + 1)]]
    whole, early = F.col("_new") & F.col(f"x{most}").isNotNull(), F.col("_new") & F.col(f"x{longest}").isNotNull() & F.col(f"x{most}").isNull()

    def sums(when, n):
        return F.array(*[F.coalesce(F.sum(F.when(when, columns[i] * columns[j])), F.lit(0.0)) for i in range(n) for j in range(i, n)])

    m1 = sums(early, longest + 2) if most > longest else F.array().cast("array<double>")
    tail = F.max_by(F.array(*columns[1:]), F.struct(*ts.by))
    return df.groupBy(*keys).agg(
        F.count_if("_new").alias("rows"), F.sum(F.when(F.col("_new"), F.col("x0"))).alias("total"), F.min(F.when(F.col("_new"), F.col("tick"))).alias("initial_time"),
        F.max("tick").alias("last_time"), m1.alias("m1"), sums(whole, most + 2).alias("m2"), F.array_compact(tail).alias("tail"), F.first("_shift").alias("shift"),
    )


def _square(upper, n: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle, row by row."""
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = upper
    return out + np.triu(out, 1).T


def _least(cross: np.ndarray, xs: list[int], y: int) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares of column ``y`` on columns ``xs`` from cross products."""
    a, b = cross[np.ix_(xs, xs)], cross[xs, y]
    try:
        beta = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        beta = np.linalg.pinv(a) @ b
    return beta, max(float(cross[y, y] - beta @ b), 0.0)


def _arma_choice(r: dict, spec: dict) -> list:
    """Model fields of a key from its cross products: two regressions, the orders by least AIC."""
    p_max, q_max, longest, most = spec["p_max"], spec["q_max"], *_arma_lags(spec)
    rows, shift, tail = int(r["rows"]), float(r["shift"]), [float(x) for x in r["tail"]]
    parts = {"m1": [float(x) for x in r["m1"]], "m2": [float(x) for x in r["m2"]]}
    memory = json.dumps({"spec": spec, "rows": rows, "total": float(r["total"]), "shift": shift, "tail": tail} | parts)
    step = (r["last_time"] - r["initial_time"]) / (rows - 1) if rows > 1 else None
    facts = [step, r["initial_time"], r["last_time"]]
    m2 = _square(parts["m2"], most + 2)
    n = int(round(m2[0, 0]))
    mean, best = float(r["total"]) / rows, None
    # Values less the mean; the error of the long autoregression is linear in them, so all sums follow from those of the values.
    centred = np.eye(most + 2)
    centred[1:, 0] = -mean
    if rows >= spec["min_training_data"]:
        ahead = m2[: longest + 2, : longest + 2] + (_square(parts["m1"], longest + 2) if parts["m1"] else 0)
        c = centred[: longest + 2, : longest + 2]
        use = [c[0], *centred[2 : p_max + 2]] if not q_max else None
        if q_max and round(ahead[0, 0]) > longest + 2:
            xs = [0, *range(2, longest + 2)]
            beta, _ = _least(c @ ahead @ c.T, xs, 1)
            errors = []
            for k in range(q_max + 1):
                e = centred[1 + k] - beta[0] * centred[0]
                for j in range(1, longest + 1):
                    e = e - beta[j] * centred[1 + k + j]
                errors.append(e)
            use = [centred[0], *centred[2 : p_max + 2], *errors[1:]]
        if use is not None:
            use = np.array([np.pad(u, (0, most + 2 - len(u))) for u in [*use, centred[1]]])
            cross, y = use @ m2 @ use.T, len(use) - 1
            for p in range(spec["p_min"], p_max + 1):
                for q in range(spec["q_min"], q_max + 1):
                    xs = [0, *range(1, p + 1), *range(p_max + 1, p_max + 1 + q)]
                    if n <= len(xs) + 2:
                        continue
                    co, sse = _least(cross, xs, y)
                    aic = n * math.log(max(sse / n, 1e-300)) + 2 * (len(xs) + 1)
                    if best is None or aic < best[0] - 1e-9:
                        best = (aic, p, q, co, math.sqrt(sse / n))
    if best is None:
        return ["arma", None, None, None, None, n, *facts, False, memory]
    _, p, q, co, sd = best
    now = np.array([1.0, *tail])
    past_e = [float(e @ now) for e in errors[:q]] if q else []
    return ["arma", co.tolist(), [p, q], [shift + mean, *[x - mean for x in tail[:p]], *past_e], sd, n, *facts, True, memory]


def arma(
    ts: TS, min_training_data: int = 20, p_min: int = 0, p_max: int = 2, q_min: int = 0, q_max: int = 2, start_training_time: int | None = None
) -> DataFrame:
    """ARMA(p, q) by two regressions (Hannan and Rissanen), the orders by least AIC.

    A long autoregression gives the errors; values are then regressed on past values and past errors.
    Both are solved from one table of cross products of lagged values, which Spark sums in one pass;
    only tiny systems per key are solved in Python. All orders are fitted on the same rows, so their
    AIC can be compared.
    """
    ts = _clean(ts, start_training_time)
    spec = {"p_min": p_min, "p_max": p_max, "q_min": q_min, "q_max": q_max, "min_training_data": min_training_data}
    # Sums about the first value lose no digits to a large mean.
    shift = ts.df.groupBy(*ts.keys).agg(F.min_by("value", F.struct(*ts.by)).alias("_shift"))
    return _models(_arma_sums(ts, shift, spec), list(ts.keys), lambda r: _arma_choice(r, spec))


def _pseudo(model: DataFrame, ts: TS, tick, value) -> DataFrame:
    """Rows of the model table as observations."""
    blank = [F.lit(None).cast(ts.df.schema[c].dataType).alias(c) for c in ts.ord]
    return model.select(*ts.keys, tick.alias("tick"), *blank, value.alias("value"))


def _arma_more(model: DataFrame, ts: TS) -> DataFrame:
    """ARMA models after the observations of ``ts``: their cross products are added to those in memory."""
    keys, out = list(ts.keys), None
    specs = model.select(F.get_json_object("memory", "$.spec").alias("s")).distinct().collect()  # as many as calls of ``arma``
    for spec in [json.loads(r.s) for r in specs]:
        part = model.where(F.get_json_object("memory", "$.spec") == json.dumps(spec, separators=(",", ":")))
        kept = F.from_json("memory", "rows long, total double, shift double, tail array<double>, m1 array<double>, m2 array<double>")
        part = part.select(*keys, "initial_time", "last_time", kept.alias("_m"))
        ago = part.select(*keys, "last_time", "_m.shift", F.posexplode("_m.tail").alias("_ago", "_x"))
        before = _pseudo(ago, ts, F.col("last_time") - F.col("_ago"), F.col("_x") + F.col("shift")).withColumn("_new", F.lit(False))
        fresh = ts.with_df(join_on(ts.df, part.select(*keys), keys, "left_semi"))
        sums = _arma_sums(fresh, part.select(*keys, F.col("_m.shift").alias("_shift")), spec, before).drop("initial_time")
        both = join_on(sums.where("rows > 0"), part.select(*keys, "initial_time", F.col("_m").alias("_m")), keys)
        add = lambda c: F.transform(F.arrays_zip(F.col(c).alias("a"), F.col(f"_m.{c}").alias("b")), lambda z: z["a"] + z["b"])
        both = both.withColumns({"rows": F.col("rows") + F.col("_m.rows"), "total": F.col("total") + F.col("_m.total"), "m1": add("m1"), "m2": add("m2")}).drop("_m")
        done = _models(both, keys, lambda r, spec=spec: _arma_choice(r, spec))
        out = done if out is None else out.unionByName(done)
    return model if out is None else out


def arima(
    ts: TS, min_training_data: int = 20, p_max: int = 2, q_max: int = 2, difference: int = 1, start_training_time: int | None = None, force_model: bool = True
) -> DataFrame:
    """ARMA on the ``difference``-times differenced values; forecasts are summed back up.

    With ``force_model`` false a key whose model does not beat the plain random walk (no terms but
    the constant, by AIC) is left as not initialised; otherwise it gets that model.
    """
    from .transforms import difference as diff

    ts = _clean(ts, start_training_time)
    work, tails = ts, []
    for _ in range(difference):
        end = work.df.groupBy(*ts.keys).agg(F.max_by("value", F.struct(*work.by)).alias(f"_y{len(tails)}"))
        tails.append(end)
        work = diff(work)
    return _summed(arma(work, min_training_data, 0, p_max, 0, q_max), tails, ts.keys, force_model)


def _summed(model: DataFrame, tails: list[DataFrame], keys, force_model: bool) -> DataFrame:
    """The model of differences as one of the values, with the last value of every level before it."""
    for end in tails:
        model = join_on(model, end, keys)
    ends = F.array(*[F.col(f"_y{i}") for i in range(len(tails))])
    memory = F.to_json(F.struct(F.lit(force_model).alias("force_model"), ends.alias("ends"), F.col("memory").alias("inner")))
    terms = F.aggregate("orders", F.lit(0), lambda a, b: a + b)
    trained = F.col("is_initialized") if force_model else F.col("is_initialized") & (terms > 0)
    return model.select(
        *keys, F.lit("arima").alias("kind"), "params", F.concat("orders", F.array(F.lit(len(tails)))).alias("orders"), F.concat(ends, F.col("state")).alias("state"),
        "sd", "error_history_length", "average_interval", "initial_time", "last_time", trained.alias("is_initialized"), memory.alias("memory"),
    )


def _arima_more(model: DataFrame, ts: TS) -> DataFrame:
    """ARIMA models after the observations of ``ts``: new values are differenced from the last ones in memory."""
    from .transforms import difference as diff

    keys, out = list(ts.keys), None
    forced = F.get_json_object("memory", "$.force_model") == "true"
    ends = F.from_json(F.get_json_object("memory", "$.ends"), "array<double>")
    for d, force in [tuple(r) for r in model.select(F.size(ends), forced).distinct().collect()]:  # as many as calls of ``arima``
        part = model.where((F.size(ends) == d) & (forced == force))
        work, tails = ts.with_df(join_on(ts.df, part.select(*keys), keys, "left_semi")), []
        for i in range(d):
            last = _pseudo(part, ts, F.col("last_time"), ends[i])
            level = work.with_df(work.df.select(*ts.columns).unionByName(last.select(*ts.columns)), fewer=False)
            tails.append(level.df.groupBy(*keys).agg(F.max_by("value", F.struct(*level.by)).alias(f"_y{i}")))
            work = diff(level)
        inner = _arma_more(part.withColumn("memory", F.get_json_object("memory", "$.inner")), work)
        done = _summed(inner, tails, keys, force)
        out = done if out is None else out.unionByName(done)
    return model if out is None else out


def exponential(ts: TS, smoothing: float = 0.3, start_training_time: int | None = None) -> DataFrame:
    """Simple exponential smoothing; ``state`` is the level, ``sd`` the root mean square one-step error."""
    from .transforms import one_step

    ts = _clean(ts, start_training_time)
    pred = one_step(ts, smoothing).df
    err = F.col("value") - F.col("forecast")
    errors = pred.groupBy(*ts.keys).agg(
        F.sqrt(F.avg(err * err)).alias("sd"), F.count("forecast").alias("error_history_length"),
        F.max_by(F.coalesce(F.col("forecast") * (1 - smoothing) + F.col("value") * smoothing, F.col("value")), F.struct(*ts.by)).alias("_level"),
    )
    table = join_on(errors, _facts(ts), ts.keys)
    return table.select(
        *ts.keys, F.lit("exponential").alias("kind"), F.array(F.lit(float(smoothing))).alias("params"),
        F.array().cast("array<int>").alias("orders"), F.array("_level").alias("state"), "sd", "error_history_length",
        "average_interval", "initial_time", "last_time", (F.col("error_history_length") >= 2).alias("is_initialized"),
        F.lit(None).cast("string").alias("memory"),
    )


def auto(
    ts: TS, samples_per_season: int | None = None, min_training_data: int = 20, start_training_time: int | None = None, error_history_length: int = 1
) -> DataFrame:
    """The model with the least one-step error per key among exponential, arma, arima and (given a season) hws.

    A model takes part once it has ``error_history_length`` one-step errors. The table keeps the
    ``candidates``, so that all of them can go on.
    """
    models = [exponential(ts, 0.3, start_training_time), arma(ts, min_training_data, start_training_time=start_training_time)]
    models.append(arima(ts, min_training_data, start_training_time=start_training_time))
    if samples_per_season:
        models.append(hws(ts, samples_per_season, start_training_time=start_training_time))
    every = models[0]
    for m in models[1:]:
        every = every.unionByName(m)
    return _best(every.withColumn("least_history", F.lit(error_history_length)), ts.keys)


def _best(every: DataFrame, keys) -> DataFrame:
    """Per key the candidate with the least error; keys that no model could be fitted to stay, not initialised."""
    good = F.col("is_initialized") & F.col("sd").isNotNull() & ~F.isnan("sd") & (F.col("error_history_length") >= F.col("least_history"))
    row = F.struct(*_TRAINED)
    plain = F.struct(*[F.lit(False).alias(n) if n == "is_initialized" else F.col(n) for n in _TRAINED])
    best = every.groupBy(*keys).agg(
        F.coalesce(F.min_by(row, F.when(good, F.struct("sd", "kind"))), F.min_by(plain, F.when(F.col("kind") == "exponential", 0).otherwise(1))).alias("m"),
        F.collect_list(F.struct(*_TRAINED, "least_history")).alias("candidates"),
    )
    return best.select(*keys, "m.*", "candidates")


# Forecasts -------------------------------------------------------------------------------------


def _path(kind, params, orders, state, sd, horizon: int):
    """Forecasts and their standard errors for 1..horizon steps ahead."""
    params, state = np.asarray(params, float), np.asarray(state, float)
    steps = np.arange(1, horizon + 1)
    if kind == "exponential":
        return np.full(horizon, state[0]), sd * np.sqrt(1 + (steps - 1) * params[0] ** 2)
    if kind in ("hws_add", "hws_mul"):
        m = orders[0]
        level, trend, season = state[0], state[1], state[2:]
        line, s = level + steps * trend, season[(steps - 1) % m]
        a, b, g = params
        # Weight of an error h-1 steps ago in the forecast, for the additive form.
        c = a * (1 + steps * b) + g * (1 - a) * (steps % m == 0)
        width = sd * np.sqrt(1 + np.concatenate([[0.0], np.cumsum(c[:-1] ** 2)]))
        return (line * s if kind == "hws_mul" else line + s), width
    d = orders[2] if kind == "arima" else 0
    ends, state = state[:d], state[d:]
    p, q = orders[0], orders[1]
    const, phi, theta = params[0], params[1 : 1 + p], params[1 + p : 1 + p + q]
    mu, v, e = state[0], list(state[1 : 1 + p]), list(state[1 + p : 1 + p + q])
    out, psi = [], [1.0]
    for _ in range(horizon):
        x = const + float(np.dot(phi, v[:p])) + float(np.dot(theta, e[:q]))
        out.append(x + mu)
        v, e = [x, *v], [0.0, *e]
    for h in range(1, horizon):
        w = theta[h - 1] if h <= q else 0.0
        psi.append(w + sum(phi[i] * psi[h - 1 - i] for i in range(min(p, h))))
    out, psi = np.array(out), np.array(psi)
    for end in ends[::-1]:
        out, psi = end + np.cumsum(out), np.cumsum(psi)
    return out, sd * np.sqrt(np.cumsum(psi**2))


def predict(model: DataFrame, keys, num_predictions: int, confidence: float = 0.95) -> DataFrame:
    """Rows (keys, tick, step, value, lower, upper, error) for the next ``num_predictions`` steps of each key.

    A key whose model is not initialised has its steps with nulls.
    """
    keys = list(keys)
    z = normal_quantile(0.5 + confidence / 2)

    def work(batches):
        for pdf in batches:
            frames = []
            for r in pdf.to_dict("records"):
                value, width = _path(r["kind"], list(r["params"]), list(r["orders"]), list(r["state"]), r["sd"], num_predictions)
                steps = np.arange(1, num_predictions + 1)
                f = pd.DataFrame({"step": steps, "value": value, "lower": value - z * width, "upper": value + z * width, "error": width})
                f["tick"] = (r["last_time"] + np.rint(steps * r["average_interval"])).astype("int64")
                for k in keys:
                    f[k] = r[k]
                frames.append(f[[*keys, "tick", "step", "value", "lower", "upper", "error"]])
            if frames:
                yield pd.concat(frames)

    schema = f"{_ddl(model, keys)}, tick long, step long, value double, lower double, upper double, error double"
    ready = F.coalesce("is_initialized", F.lit(False))
    none = [F.lit(None).cast("double").alias(c) for c in ("value", "lower", "upper", "error")]
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(num_predictions).cast("long"))).alias("step")
    missing = model.where(~ready).select(*keys, F.lit(None).cast("long").alias("tick"), steps, *none) if num_predictions > 0 else None
    found = model.where(ready).mapInPandas(work, schema)
    return found if missing is None else found.unionByName(missing)


_MODELS = {"hws": hws, "arma": arma, "arima": arima, "auto": auto, "exponential": exponential}


def forecast(ts: TS, num_predictions: int, model="auto", confidence: float = 0.95, start_training_time: int | None = None, **arguments) -> DataFrame:
    """Fit (or take a model table) and predict ``num_predictions`` steps per key."""
    table = model if isinstance(model, DataFrame) else _MODELS[model](ts, start_training_time=start_training_time, **arguments)
    return predict(table, ts.keys, num_predictions, confidence)


def forecast_at(model: DataFrame, keys, probes: DataFrame, confidence: float = 0.95, tick_col: str = "t") -> DataFrame:
    """Value, bounds and error at the ticks of a probe table (keys, ``tick_col``); null before the first step.

    A tick between two steps belongs to the nearest one.
    """
    keys = list(keys)
    z = normal_quantile(0.5 + confidence / 2)
    both = join_on(probes, model.where("is_initialized").select(*keys, *_NAMES), keys, "left")
    extra = [c for c in probes.columns if c not in keys]

    def work(batches):
        for pdf in batches:
            value, error = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            for i, r in enumerate(pdf.to_dict("records")):
                if r["kind"] is None or not r["average_interval"]:
                    continue
                h = int(np.rint((r[tick_col] - r["last_time"]) / r["average_interval"]))
                if h >= 1:
                    v, w = _path(r["kind"], list(r["params"]), list(r["orders"]), list(r["state"]), r["sd"], h)
                    value[i], error[i] = v[-1], w[-1]
            out = pdf[[*keys, *extra]].copy()
            out["forecast"], out["lower"], out["upper"], out["error"] = value, value - z * error, value + z * error, error
            yield out

    schema = f"{_ddl(probes, [*keys, *extra])}, forecast double, lower double, upper double, error double"
    return both.mapInPandas(work, schema)


def is_anomaly(model: DataFrame, keys, probes: DataFrame, confidence: float = 0.95, tick_col: str = "t") -> DataFrame:
    """Adds ``is_anomaly`` to probes (keys, ``tick_col``, ``value``): outside the bounds, or NaN."""
    # NaN would become null on its way through Arrow, so it is noted before.
    noted = probes.withColumn("value", F.col("value").cast("double")).withColumn("_nan", F.isnan("value"))
    out = forecast_at(model, keys, noted, confidence, tick_col)
    v = F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("value"))
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return out.withColumn("is_anomaly", F.col("_nan") | outside).withColumn("value", v).drop("_nan")


def _continued(model: DataFrame, ts: TS) -> DataFrame:
    """Exponential models after the observations behind their last tick: the level goes on from where it stood."""
    from .transforms import one_step

    keys, out = list(ts.keys), None
    for (smoothing,) in model.select(F.col("params")[0]).distinct().collect():  # weights are chosen by hand: few
        part = model.where(F.col("params")[0] == smoothing)
        fresh = join_on(ts.df, part.select(*keys, "last_time"), keys).where(F.col("tick") > F.col("last_time")).drop("last_time")
        blank = [F.lit(None).cast(ts.df.schema[c].dataType).alias(c) for c in ts.ord]
        start = part.select(*keys, F.col("last_time").alias("tick"), *blank, F.col("state")[0].alias("value"))
        both = _clean(ts.with_df(fresh.select(*ts.columns).unionByName(start.select(*ts.columns)), fewer=False), None)
        pred = one_step(both, smoothing).df
        err = F.col("value") - F.col("forecast")
        step = pred.groupBy(*keys).agg(
            F.coalesce(F.sum(err * err), F.lit(0.0)).alias("_e"), F.count("forecast").alias("_m"), F.max("tick").alias("_t"),
            F.max_by(F.coalesce(F.col("forecast") * (1 - smoothing) + F.col("value") * smoothing, F.col("value")), F.struct(*both.by)).alias("_level"),
        )
        n = F.col("error_history_length") + F.col("_m")
        done = join_on(part, step, keys).select(
            *keys, "kind", "params", "orders", F.array("_level").alias("state"),
            F.sqrt((F.coalesce(F.col("sd") * F.col("sd") * F.col("error_history_length"), F.lit(0.0)) + F.col("_e")) / n).alias("sd"),
            n.alias("error_history_length"), ((F.col("_t") - F.col("initial_time")) / n).alias("average_interval"), "initial_time",
            F.col("_t").alias("last_time"), (n >= 2).alias("is_initialized"), "memory",
        )
        out = done if out is None else out.unionByName(done)
    return model if out is None else out


def update_model(model: DataFrame, ts: TS, fit=None, **arguments) -> DataFrame:
    """The models after the observations of ``ts`` behind their last tick; other keys keep their row.

    Every kind goes on from what its row remembers, also one that is not initialised yet, so ``ts``
    need only hold what is new: the result is what training on the whole history would have given.
    Keys without a model, and rows without a memory (of another origin than ``hws``, ``arma``,
    ``arima``, ``exponential`` and ``auto``), are fitted by ``fit`` to the rows given; without
    ``fit`` they stay as they are.
    """
    keys = list(ts.keys)
    if "candidates" in model.columns:
        return _auto_more(model, ts, fit, **arguments)
    if "memory" not in model.columns:
        model = model.withColumn("memory", F.lit(None).cast("string"))
    clean = _clean(ts)
    behind = join_on(clean.df, model.select(*keys, "last_time"), keys).where(F.col("tick") > F.col("last_time")).drop("last_time")
    behind = clean.with_df(behind)
    moved = join_on(model, behind.df.select(*keys).distinct(), keys, "left_semi")
    level = (F.col("kind") == "exponential") & F.col("state")[0].isNotNull()
    how = F.when(level, "level").when(F.col("memory").isNull(), "none").when(F.col("kind").startswith("hws"), "hws").otherwise(F.col("kind"))
    moved = saved(moved.select(*keys, *_TRAINED, F.coalesce(how, F.lit("none")).alias("_how")))
    kinds = {r[0] for r in moved.select("_how").distinct().collect()}  # five at most
    out = join_on(model, moved.where("_how <> 'none'").select(*keys), keys, "left_anti").select(*keys, *_TRAINED)
    for kind, more in (("level", _continued), ("hws", _hws_more), ("arma", _arma_more), ("arima", _arima_more)):
        if kind in kinds:
            part = moved.where(F.col("_how") == kind).drop("_how")
            own = behind.with_df(join_on(behind.df, part.select(*keys), keys, "left_semi"))
            out = out.unionByName(more(part, own).select(*keys, *_TRAINED))
    if fit is None:
        return out
    lost = moved.where("_how = 'none'").select(*keys)
    refit = join_on(ts.df, join_on(model.select(*keys), lost, keys, "left_anti"), keys, "left_anti")
    fresh = fit(ts.with_df(refit), **arguments)
    if "memory" not in fresh.columns:
        fresh = fresh.withColumn("memory", F.lit(None).cast("string"))
    return join_on(out, lost, keys, "left_anti").unionByName(fresh.select(*keys, *_TRAINED))


def _auto_more(model: DataFrame, ts: TS, fit, **arguments) -> DataFrame:
    """``auto`` after new observations: every candidate goes on, then the best is chosen again."""
    keys = list(ts.keys)
    every = saved(model.select(*keys, F.explode("candidates").alias("c")).select(*keys, "c.*"))
    out = None
    for kind in ("exponential", "arma", "arima", "hws_add", "hws_mul"):
        part = every.where(F.col("kind") == kind)
        moved = join_on(update_model(part.drop("least_history"), ts), part.select(*keys, "least_history"), keys)
        out = moved if out is None else out.unionByName(moved)
    best = _best(out, keys)
    if fit is None:
        return best
    fresh = fit(ts.with_df(join_on(ts.df, model.select(*keys), keys, "left_anti")), **arguments)
    return best.unionByName(fresh.select(*best.columns))


def online_state(model: DataFrame, keys) -> DataFrame:
    """(keys, ``_init``): every model as the state that ``online`` steps begin with."""
    ready = F.coalesce("is_initialized", F.lit(False))
    m = F.struct(
        "kind", "params", "orders", F.when(ready, F.col("state")).alias("state"), F.coalesce(F.col("sd") * F.col("sd") * F.col("error_history_length"), F.lit(0.0)).alias("sse"),
        F.coalesce("error_history_length", F.lit(0)).alias("n"),
    )
    return model.select(*keys, F.to_json(m).alias("_init"))


def one_step_ahead(ts: TS, model: DataFrame, confidence: float = 0.95, learn: bool = True, rows: int = 50_000) -> DataFrame:
    """Rows of ``ts`` behind the models' last ticks with ``forecast, lower, upper, is_anomaly`` from the model before each.

    With ``learn`` a model's state and error follow every observation; its weights stay.
    """
    z = normal_quantile(0.5 + confidence / 2)
    keys, carried = list(ts.keys), ["tick", *ts.ord, "value"]
    behind = join_on(ts.df, model.select(*keys, "last_time"), keys).where(F.col("tick") > F.col("last_time")).select(*ts.columns)
    behind = behind.withColumn("value", F.col("value").cast("double"))

    def step(pdf, state):
        out, state = tested(pdf, state, z, learn)
        return pd.concat([pdf[carried].reset_index(drop=True), out], axis=1), state

    kinds = ", ".join(f"`{c}` {behind.schema[c].dataType.simpleString()}" for c in carried)
    schema = f"{kinds}, forecast double, lower double, upper double, is_anomaly boolean"
    return fold(behind, keys, ts.by, carried, step, "{}", schema, min(rows, ts.chunk_rows), online_state(model, keys))


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def reset_model(model: DataFrame, keys: DataFrame) -> DataFrame:
    """The model table without the given keys."""
    return join_on(model, keys, keys.columns, "left_anti")
