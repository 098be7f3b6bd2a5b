"""Distribution tails and gamma-family functions in numpy, and Arrow UDFs over them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_erfc = np.vectorize(math.erfc, otypes=[float])
lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_sf(x):
    return 0.5 * _erfc(np.asarray(x, dtype=float) / math.sqrt(2))


def norm_pdf(x, mean=0.0, sd=1.0):
    z = (np.asarray(x, dtype=float) - mean) / sd
    return np.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def norm_isf(p):
    """Quantile of the upper tail; infinite at 0 and 1."""
    inv = NormalDist().inv_cdf

    def one(q):
        if math.isnan(q):
            return math.nan
        return math.inf if q <= 0 else -math.inf if q >= 1 else -inv(q)

    return np.array([one(float(q)) for q in np.atleast_1d(p)])


def gamma_pdf(x, shape, scale):
    x = np.asarray(x, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.exp((shape - 1) * np.log(x) - x / scale - lgamma(shape) - shape * np.log(scale))
    at_zero = np.inf if shape < 1 else 1 / scale if shape == 1 else 0.0
    return np.where(x < 0, 0.0, np.where(x == 0, at_zero, out))


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2, x / 2)


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def hypergeom_sf_at(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) for X marked ones among ``drawn`` of ``total``: Fisher's exact test, greater."""

    def choose(n, r):
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    lo, hi = max(k, drawn + marked - total, 0), min(drawn, marked)
    base = choose(total, drawn)
    return min(1.0, sum(math.exp(choose(marked, i) + choose(total - marked, drawn - i) - base) for i in range(lo, hi + 1)))


def digamma(x):
    x = np.array(x, dtype=float, ndmin=1)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x):
    x = np.array(x, dtype=float, ndmin=1)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] += 1 / x[low] ** 2
        x[low] += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def _each(f, *columns: pd.Series) -> pd.Series:
    rows = zip(*(c.to_numpy(dtype=float) for c in columns))
    return pd.Series([math.nan if any(map(math.isnan, r)) else f(*r) for r in rows], dtype=float)


def udfs() -> dict:
    """Arrow UDFs by name; null in, null out (as NaN turned to null)."""

    @F.pandas_udf("double")
    def normal_sf(x: pd.Series) -> pd.Series:
        return pd.Series(norm_sf(x.to_numpy(dtype=float)))

    @F.pandas_udf("double")
    def normal_isf(p: pd.Series) -> pd.Series:
        return pd.Series(norm_isf(p.to_numpy(dtype=float)))

    @F.pandas_udf("double")
    def student_sf(t: pd.Series, df: pd.Series) -> pd.Series:
        return _each(t_sf, t, df)

    @F.pandas_udf("double")
    def chisq_sf(x: pd.Series, df: pd.Series) -> pd.Series:
        return _each(chi2_sf, x, df)

    @F.pandas_udf("double")
    def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _each(lambda w, x, y, z: hypergeom_sf_at(int(w), int(w + x + y + z), int(w + y), int(w + x)), a, b, c, d)

    return {f.__name__: f for f in (normal_sf, normal_isf, student_sf, chisq_sf, fisher_greater)}
