"""p-values in Arrow batches: chi-square (1 df), binomial upper tail, two-sided t."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: float) -> float:
    return math.erfc(math.sqrt(x / 2)) if x >= 0 else float("nan")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), summed from log terms away from the mode."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, math.fsum(map(term, range(k, n + 1)))) if k > n * p else max(0.0, 1 - math.fsum(map(term, range(k))))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_tail(t: float, df: float) -> float:
    return beta_fraction(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def _batched(f, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*xs, strict=True)], dtype="float64")

    return run(*cols)


def chi2_p1(x: Column) -> Column:
    return _batched(chi2_tail, x)


def binom_sf(k: Column, n: Column, p: Column) -> Column:
    return _batched(lambda a, b, c: binomial_tail(int(a), int(b), c), k, n, p)


def t_p(t: Column, df: Column) -> Column:
    return _batched(t_tail, t, df)
