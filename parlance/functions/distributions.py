"""Tail probabilities of the usual test statistics, as Arrow functions; no statistics library is needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 400):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """The value that Student's t stays under with probability p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def rank_sum_ways(n1: int, n2: int) -> np.ndarray:
    """The number of orders of two samples with each value of U."""
    table: dict[tuple[int, int], np.ndarray] = {}
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            out = np.zeros(i * j + 1)
            if not i or not j:
                out[0] = 1
            else:
                out[j:] += table[i - 1, j]
                out[: i * (j - 1) + 1] += table[i, j - 1]
            table[i, j] = out
    return table[n1, n2]


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of Mann-Whitney U without ties."""
    ways = rank_sum_ways(n1, n2)
    return min(1.0, 2 * ways[: int(min(u, n1 * n2 - u)) + 1].sum() / ways.sum())


def _each(f, *columns) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return _each(lambda a, b: t_two_sided(a, b) if b > 0 else None, t, df)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper p of F."""
    return _each(lambda a, b, c: f_upper(a, b, c) if a >= 0 and b > 0 and c > 0 else None, f, d1, d2)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a normal z."""
    return _each(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p of Mann-Whitney U: exact for samples of up to 8 without ties, else normal with continuity and tie correction.

    ``ties``: the sum of t^3 - t over groups of t equal values.
    """

    def p(u, n1, n2, ties):
        if ties == 0 and min(n1, n2) <= 8 and n1 * n2 <= 400:
            return rank_sum_exact(u, int(n1), int(n2))
        n = n1 + n2
        var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
        return None if var <= 0 else min(1.0, normal_two_sided(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)))

    return _each(p, u, n1, n2, ties)
