"""Tail probabilities and the Beta quantile, for result-size tables only."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log10_two_sided(z: float) -> float:
    """log10 of the two-sided normal p-value, also far in the tail."""
    z = abs(z)
    if z < 30:
        return math.log10(math.erfc(z / math.sqrt(2)))
    log_tail = -z * z / 2 - math.log(z) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / (z * z))
    return math.log10(2) + log_tail / math.log(10)


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete beta fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return total


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(scale) * _continued_fraction(a, b, x) / a
    return 1 - math.exp(scale) * _continued_fraction(b, a, 1 - x) / b


def beta_quantile(share: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < share else (low, mid)
    return (low + high) / 2


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def _mapped(function, *series: pd.Series) -> pd.Series:
    rows = zip(*series)
    return pd.Series([None if any(pd.isna(v) for v in r) else function(*r) for r in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def log10_p_of_z(z: pd.Series) -> pd.Series:
    return _mapped(log10_two_sided, z)


@F.pandas_udf(DoubleType())
def p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def beta_point(share: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _mapped(beta_quantile, share, a, b)
