"""Tail probabilities for a handful of aggregated statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1.0 - s
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def ks_upper(d: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    root = math.sqrt(n * m / (n + m))
    lam = (root + 0.12 + 0.11 / root) * d
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _batch(fn, *xs: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in vs) else float(fn(*map(float, vs))) for vs in zip(*xs)], dtype="float64")


def _two(fn, a: Column, b: Column) -> Column:
    """Apply a scalar function to aggregated rows as an Arrow batch."""

    @F.pandas_udf("double")
    def call(x: pd.Series, y: pd.Series) -> pd.Series:
        return _batch(fn, x, y)

    return call(a, b)


def _three(fn, a: Column, b: Column, c: Column) -> Column:
    @F.pandas_udf("double")
    def call(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return _batch(fn, x, y, z)

    return call(a, b, c)


def t_p_value(t: Column, df: Column) -> Column:
    return _two(t_two_sided, t, df)


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _three(f_upper, f, d1, d2)


def chi2_p_value(x: Column, df: Column) -> Column:
    return _two(chi2_upper, x, df)


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    return _three(ks_upper, d, n, m)


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail in the JVM (Abramowitz-Stegun 7.1.26, error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
