"""Special functions that SQL lacks: tails of the chi-square, t and binomial distributions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_tail(x: float) -> float:
    """P(X >= x) for one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_ratio(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for step in range(2000 + int(20 * math.sqrt(a + b))):  # modified Lentz; large parameters need more steps
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (value - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_ratio(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, for p of a half or more, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value by the t approximation."""
    if n < 3 or rho is None or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def least_detectable_rho(n: int, alpha: float) -> float:
    """The smallest |rho| that a two-sided test at this n calls significant."""
    t = t_quantile(1 - alpha / 2, n - 2)
    return t / math.sqrt(n - 2 + t * t)


def half_tail(k: int, n: int) -> float:
    """P(X <= k) for n fair trials."""
    return 1.0 if k >= n else beta_ratio(n - k, k + 1, 0.5)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for n trials."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(0, k), n + 1))


@F.pandas_udf(DoubleType())
def chi2_tail_udf(x: pd.Series) -> pd.Series:
    return x.map(chi2_tail)


@F.pandas_udf(DoubleType())
def spearman_p_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([spearman_p(r, int(k)) for r, k in zip(rho, n)])


@F.pandas_udf(DoubleType())
def half_tail_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([half_tail(int(a), int(b)) if b == b and b else 1.0 for a, b in zip(k, n)])
