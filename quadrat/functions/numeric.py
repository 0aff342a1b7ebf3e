"""Numeric column functions that Spark does not have."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if not isinstance(c, Column) else c


def ratio(top, bottom) -> Column:
    """``top / bottom`` as a double; NULL where ``bottom`` is 0 or either is NULL, in ANSI mode too."""
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def f_ratio(top, bottom, scale: float | Column = 0.0) -> Column:
    """An F statistic: infinite where nothing is left to explain (``bottom`` within 1e-12 of ``scale``), NULL if both sides are 0."""
    small = F.greatest(F.abs(_col(scale).cast("double")) * 1e-12, F.lit(0.0))
    top, bottom = _col(top).cast("double"), _col(bottom).cast("double")
    return F.when(bottom > small, F.try_divide(top, bottom)).when(top > small, F.lit(float("inf")))


def lgamma(col) -> Column:
    """log gamma of x >= 1 by Stirling's series at x + 8, as plain column arithmetic."""
    x = _col(col).cast("double")
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return stirling - F.log(product)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(h))


def logit_clip(p, eps: float = 1e-9) -> Column:
    q = F.least(F.greatest(_col(p), F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def gamma_inc_upper(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def tail(name: str, x: float, d1: float | None = None, d2: float | None = None) -> float:
    """Two-sided p of normal and t, upper tail of chi-square and F."""
    if x is None or x != x:
        return math.nan
    x = float(x)
    if math.isinf(x):
        return 0.0 if x > 0 or name in ("normal", "t") else 1.0
    if name == "normal":
        return math.erfc(abs(x) / math.sqrt(2))
    if name == "t":
        return beta_inc(d1 / 2, 0.5, d1 / (d1 + x * x))
    if name == "chi2":
        return gamma_inc_upper(d1 / 2, x / 2)
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def pdist(name: str, x, d1=None, d2=None) -> Column:
    """p-value column for a (small) table of test statistics."""

    @F.pandas_udf("double")
    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tail(name, *row) for row in zip(x.astype(float), a.astype(float), b.astype(float))], dtype=float)

    none = F.lit(None).cast("double")
    return run(_col(x).cast("double"), none if d1 is None else _col(d1).cast("double"), none if d2 is None else _col(d2).cast("double"))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its tail; NaN without degrees of freedom."""
    if not df >= 1:
        return math.nan
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail("t", mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def symmetric_solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum-norm solution, so aliased columns do not fail."""
    return np.linalg.pinv(gram, hermitian=True) @ right
