"""Tail probabilities that Spark has no function for, on one number a series: numpy in pandas UDFs."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import _col


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The incomplete beta function's continued fraction, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    out = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + numerator * d or tiny)
            c = 1.0 + numerator / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    if math.isinf(t):
        return 0.0
    return beta_share(df / 2, 0.5, df / (df + t * t))


@lru_cache(4096)
def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@lru_cache(256)
def _kendall_counts(n: int) -> tuple[int, ...]:
    """Permutations of n things by their number of inversions."""
    counts = [1]
    for k in range(2, n + 1):
        out, run = [], 0
        for i in range(len(counts) + k - 1):
            run += counts[i] if i < len(counts) else 0
            run -= counts[i - k] if i >= k else 0
            out.append(run)
        counts = out
    return tuple(counts)


def kendall_two_sided(s: float, n: int, variance: float, ties: bool) -> float | None:
    """The two-sided p of Kendall's S: exact for few values without ties (or an extreme S), else normal with the given variance."""
    if n < 2 or variance <= 0:
        return None
    pairs = n * (n - 1) // 2
    discordant = round((pairs - s) / 2)
    c = min(discordant, pairs - discordant)
    if not ties and (n <= 33 or c <= 1):
        if 2 * c == pairs:
            return 1.0
        if n <= 33:
            return min(1.0, 2 * sum(_kendall_counts(n)[: c + 1]) / math.factorial(n))
        return 2 * (1 if c == 0 else n) / math.factorial(n)
    return math.erfc(abs(s) / math.sqrt(variance) / math.sqrt(2))


def t_p_value(t: str | Column, df: str | Column) -> Column:
    """Two-sided; null where t or df is null or df is below 1."""

    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) or pd.isna(n) or n < 1 else t_two_sided(float(t), float(n)) for t, n in zip(ts, dfs)], dtype="Float64")

    return F.pandas_udf(run, "double")(_col(t).cast("double"), _col(df).cast("double"))


def t_critical(df: str | Column, p: float = 0.975) -> Column:
    def run(dfs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(n) or n < 1 else t_quantile(p, float(n)) for n in dfs], dtype="Float64")

    return F.pandas_udf(run, "double")(_col(df).cast("double"))


def kendall_p_value(s: str | Column, n: str | Column, variance: str | Column, ties: str | Column) -> Column:
    def run(ss: pd.Series, ns: pd.Series, vs: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(s) else kendall_two_sided(float(s), int(n), float(v), bool(t)) for s, n, v, t in zip(ss, ns, vs, ts)], dtype="Float64")

    return F.pandas_udf(run, "double")(_col(s).cast("double"), _col(n).cast("long"), _col(variance).cast("double"), _col(ties).cast("boolean"))
