"""One observation at a time: forecasts one step ahead, and model states after an observation.

The states are those of the model table (see ``forecast``); weights and coefficients stay as trained.
These are the steps that batch ``fold`` and streams share.
"""

from __future__ import annotations

import json
import math

import pandas as pd


def ahead(m: dict) -> float:
    """The forecast of the next observation."""
    kind, state, params = m["kind"], m["state"], m["params"]
    if kind == "exponential":
        return state[0]
    if kind in ("hws_add", "hws_mul"):
        line = state[0] + state[1]
        return line * state[2] if kind == "hws_mul" else line + state[2]
    d = m["orders"][2] if kind == "arima" else 0
    return sum(state[:d]) + _arma_ahead(params, m["orders"], state[d:])


def _arma_ahead(params, orders, state) -> float:
    p, q = orders[0], orders[1]
    terms = [*zip(params[1 : 1 + p], state[1 : 1 + p]), *zip(params[1 + p : 1 + p + q], state[1 + p : 1 + p + q])]
    return state[0] + params[0] + sum(a * b for a, b in terms)


def advance(m: dict, v: float) -> list[float]:
    """The state after observation ``v``."""
    kind, state, params = m["kind"], m["state"], m["params"]
    if kind == "exponential":
        return [params[0] * v + (1 - params[0]) * state[0]]
    if kind in ("hws_add", "hws_mul"):
        a, b, g = params
        level, trend, season = state[0], state[1], state[2:]
        s, line = season[0], state[0] + state[1]
        if kind == "hws_mul":
            new = a * (v / s if s else math.nan) + (1 - a) * line
            fresh = v / new if new else math.nan
        else:
            new = a * (v - s) + (1 - a) * line
            fresh = v - new
        return [new, b * (new - level) + (1 - b) * trend, *season[1:], g * fresh + (1 - g) * s]
    d = m["orders"][2] if kind == "arima" else 0
    ends, x = [], v
    for end in state[:d]:
        ends.append(x)
        x -= end
    mu, p, q = state[d], m["orders"][0], m["orders"][1]
    inner = state[d:]
    error = x - _arma_ahead(params, m["orders"], inner)
    return [*ends, mu, *[x - mu, *inner[1 : 1 + p]][:p], *[error, *inner[1 + p :]][:q]]


def tested(block: pd.DataFrame, text: str, z: float, learn: bool = True) -> tuple[pd.DataFrame, str]:
    """Each observation against the forecast before it: ``forecast, lower, upper, is_anomaly``; resumable.

    The state is a model as JSON with ``sse`` and ``n`` of its one-step errors. With ``learn`` the
    state follows every observation and the bounds its errors; a missing value moves nothing.
    Without, all observations of a block are held against forecasts from the state as it was,
    further and further ahead.
    """
    m = json.loads(text)
    out = []
    for v in block["value"].tolist():
        missing = v is None or v != v
        if m.get("state") is None:
            out.append([None, None, None, bool(missing and v is not None)])
            continue
        f = ahead(m)
        width = z * math.sqrt(m["sse"] / m["n"]) if m["n"] else None
        lo, hi = (f - width, f + width) if width is not None else (None, None)
        out.append([f, lo, hi, bool(missing and v is not None) or (not missing and lo is not None and not lo <= v <= hi)])
        if learn and not missing:
            m["state"] = advance(m, v)
            m["sse"], m["n"] = m["sse"] + (v - f) ** 2, m["n"] + 1
        elif not learn:
            m["state"] = advance(m, f)
    return pd.DataFrame(out, columns=["forecast", "lower", "upper", "is_anomaly"]), json.dumps(m)
