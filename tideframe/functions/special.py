"""Tail probabilities that Spark has no function for, vectorised over numpy arrays."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np



def chi2_tail(x, dof):
    """P(X > x) for a chi-squared variable."""
    x, a = np.broadcast_arrays(np.atleast_1d(np.asarray(x, float)) / 2, np.asarray(dof, float) / 2)
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(x) & (a > 0)
    for i in zip(*np.nonzero(ok)):
        out[i] = 1.0 if x[i] <= 0 else _gamma_upper(float(a[i]), float(x[i]))
    return out


def _gamma_upper(a: float, x: float) -> float:
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    return front * _fraction(lambda i: x + 2 * i + 1 - a, lambda i: -i * (i - a))


def _fraction(b, a) -> float:
    """Value of 1 / (b(0) + a(1) / (b(1) + a(2) / (b(2) + ...))), evaluated forwards."""
    tiny = 1e-300
    f = b(0) or tiny
    c, d = f, 0.0
    for i in range(1, 10_000):
        d = b(i) + a(i) * d or tiny
        c = b(i) + a(i) / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 / f


def _beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_reg(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))

    def num(i):
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    return front / a * _fraction(lambda i: 1.0, num)


def f_tail(x, d1, d2):
    """P(X > x) for an F variable."""
    x, d1, d2 = np.broadcast_arrays(np.atleast_1d(np.asarray(x, float)), np.asarray(d1, float), np.asarray(d2, float))
    out = np.full(x.shape, np.nan)
    for i in zip(*np.nonzero(np.isfinite(x) & (d1 > 0) & (d2 > 0))):
        out[i] = 1.0 if x[i] <= 0 else _beta_reg(d2[i] / 2, d1[i] / 2, d2[i] / (d2[i] + d1[i] * x[i]))
    return out


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# MacKinnon (2010) response surface for the unit-root test with a constant,
# level -> (b0, b1, b2, b3) of b0 + b1/n + b2/n^2 + b3/n^3.
UNIT_ROOT_SURFACE = {
    0.01: (-3.43035, -6.5393, -16.786, -79.433),
    0.05: (-2.86154, -2.8903, -4.234, -40.040),
    0.10: (-2.56677, -1.5384, -2.809, 0.0),
}


def unit_root_critical(level: float, n):
    """Critical value of the augmented Dickey-Fuller statistic at ``level`` for ``n`` rows."""
    b = UNIT_ROOT_SURFACE[level]
    n = np.asarray(n, float)
    return b[0] + b[1] / n + b[2] / n**2 + b[3] / n**3
