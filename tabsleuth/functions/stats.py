"""Scalar statistics helpers: column expressions and small numeric routines.

The numeric routines (F-distribution survival, normal quantile) run on a
handful of result rows - one per column pair - never per data row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


_TINY = 1e-300
_EPS = 1e-15


def _betacf(a: float, b: float, x: float, y: float) -> float:
    """Continued fraction of the regularised incomplete beta (modified Lentz);
    it converges in O(sqrt(max(a, b))) steps for x < (a + 1) / (a + b + 2)."""
    keep = lambda v: v if abs(v) > _TINY else _TINY
    first = 1.0 - (a + b) * x / (a + 1.0) if x < 0.5 else (1.0 - b + (a + b) * y) / (a + 1.0)  # equal, without cancellation
    c, d = 1.0, 1.0 / keep(first)
    h, m, delta = d, 1, 0.0
    while abs(delta - 1.0) >= _EPS:
        aa = m * (b - m) * x / ((a - 1.0 + 2 * m) * (a + 2 * m))
        d, c = 1.0 / keep(1.0 + aa * d), keep(1.0 + aa / c)
        h *= d * c
        aa = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1.0 + 2 * m))
        d, c = 1.0 / keep(1.0 + aa * d), keep(1.0 + aa / c)
        delta = d * c
        h *= delta
        m += 1
    return h


def _lgamma_step(x: float, by: float) -> float:
    """lgamma(x + by) - lgamma(x), without cancellation for large x."""
    if x < 1e3:
        return math.lgamma(x + by) - math.lgamma(x)
    rest = lambda v: 1 / (12 * v) - 1 / (360 * v**3)
    return (x + by - 0.5) * math.log1p(by / x) + by * math.log(x) - by + rest(x + by) - rest(x)


def _beta_tail(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta I_x(a, b), with y = 1 - x given exactly."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    large, small = max(a, b), min(a, b)
    front = _lgamma_step(large, small) - math.lgamma(small) + a * (math.log1p(-y) if x > 0.5 else math.log(x)) + b * (math.log1p(-x) if y > 0.5 else math.log(y))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(front) * _betacf(a, b, x, y) / a
    return 1.0 - math.exp(front) * _betacf(b, a, y, x) / b


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    return _beta_tail(a, b, x, 1.0 - x)


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f) for an F(d1, d2) distribution."""
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0:
        return float("nan")
    if math.isnan(f):
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return _beta_tail(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


@F.pandas_udf(DoubleType())
def f_pvalue_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Vectorised over the (few) ANOVA result rows: p-value of F."""
    return pd.Series([f_survival(a, b, c) if pd.notna(a) else float("nan") for a, b, c in zip(f, d1, d2)], dtype="float64")


#: from this shape on, the uniform expansion is exact to double precision
_LARGE_SHAPE = 1e6


def _gamma_tail_large(a: float, z: float) -> float:
    """Q(a, z) for large a: uniform asymptotic expansion, two terms."""
    mu = (z - a) / a
    eta = math.copysign(math.sqrt(max(0.0, 2 * (mu - math.log1p(mu)))), mu)
    if abs(eta) < 0.05:
        # Taylor coefficients of 1/mu - 1/eta around 0.
        first = -1 / 3 + eta * (1 / 12 + eta * (-2 / 135 + eta * (1 / 864 + eta / 2835)))
    else:
        first = 1 / mu - 1 / eta
    rest = math.exp(-0.5 * a * eta * eta) / math.sqrt(2 * math.pi * a) * first
    return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(a / 2)) + rest))


def chi2_survival(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q)."""
    if x is None or k is None or k <= 0 or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, z = k / 2.0, x / 2.0
    if a >= _LARGE_SHAPE:
        return _gamma_tail_large(a, z)
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:  # power series; its terms fall from the first on
        term = total = 1.0 / a
        ap = a
        while term >= total * _EPS:
            ap += 1
            term *= z / ap
            total += term
        return max(0.0, 1.0 - total * front)
    keep = lambda v: v if abs(v) > _TINY else _TINY
    b, c, d = z + 1 - a, 1 / _TINY, 1 / keep(z + 1 - a)
    h, i, delta = d, 1, 0.0
    while abs(delta - 1) >= _EPS:
        an = -i * (i - a)
        b += 2
        d, c = 1 / keep(an * d + b), keep(b + an / c)
        delta = d * c
        h *= delta
        i += 1
    return front * h


@F.pandas_udf(DoubleType())
def chi2_pvalue_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    """Vectorised over the per-pair rows: p-value of chi2 with k dof."""
    return pd.Series([chi2_survival(float(a), float(b)) if pd.notna(a) else float("nan") for a, b in zip(x, k)], dtype="float64")


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
