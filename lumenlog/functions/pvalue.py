"""p-values and quantiles of result rows (never of data rows)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of a correlation of ``n`` pairs under the t distribution."""
    if n < 3 or r != r:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection of the distribution function (upper half)."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_two_sided(mid, df) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def correlation_p_value(r: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def udf(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, b) for a, b in zip(rs.fillna(float("nan")), ns)])

    return udf(r.cast("double"), n.cast("double"))


def t_quantile_column(p: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def udf(dfs: pd.Series) -> pd.Series:
        return pd.Series([t_quantile(p, d) if d > 0 else float("nan") for d in dfs])

    return udf(df.cast("double"))
