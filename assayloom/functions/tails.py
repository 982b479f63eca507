"""Tail probabilities of the test statistics, vectorised over Arrow batches.

They run on one row per tested feature, after all aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    total = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        total *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        total *= step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    else:
        # rounding may keep a step from settling to the last digit
        if not np.all(np.abs(step - 1.0) < 1e-12):
            raise ArithmeticError("the incomplete beta function has not converged")
    return total


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function; nan where an argument is nan."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    known = np.isfinite(a) & np.isfinite(b) & ~np.isnan(x)
    out[known & (x <= 0)] = 0.0
    out[known & (x >= 1)] = 1.0
    inner = known & (x > 0) & (x < 1)
    if inner.any():
        p, q, z = a[inner], b[inner], x[inner]
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z))
        direct = z < (p + 1.0) / (p + q + 2.0)  # else use the symmetric form, which converges faster
        u, v, w = np.where(direct, p, q), np.where(direct, q, p), np.where(direct, z, 1.0 - z)
        part = front * _beta_fraction(u, v, w) / u
        out[inner] = np.where(direct, part, 1.0 - part)
    return out


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) of Student's distribution; an infinite t gives 0."""
    squared = t.to_numpy(dtype=float) ** 2
    freedom = df.to_numpy(dtype=float)
    with np.errstate(invalid="ignore"):
        x = np.where(np.isinf(squared), 0.0, freedom / (freedom + squared))
    return pd.Series(incomplete_beta(freedom / 2.0, 0.5, x))


@pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F >= f) of Fisher's distribution; an infinite f gives 0."""
    f, d1, d2 = (s.to_numpy(dtype=float) for s in (f, d1, d2))
    with np.errstate(invalid="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
    return pd.Series(incomplete_beta(d2 / 2.0, d1 / 2.0, x))


def rank_sum_lower(n1: int, n2: int, upto: int) -> np.ndarray:
    """P(U <= u) for u = 0 .. upto without ties (Mann and Whitney's recursion).

    Only the ``upto`` + 1 numbers asked for are held, for those above don't touch them. Each
    step is scaled to shares of all arrangements, in numpy's widest floats: their range of
    exponents holds the share of a single one for groups of up to 8,000 against 8,000. Rounding
    grows with the sizes: below 1e-12 at 200 against 200, below 1e-6 at 600 against 600.
    """
    small, large = sorted((n1, n2))
    share = np.zeros(min(upto, small * large) + 1, dtype=np.longdouble)
    share[0] = 1.0
    for i in range(1, small + 1):
        # multiply by (1 - q^(large + i)) and divide by (1 - q^i)
        if large + i < len(share):
            share[large + i :] -= share[: len(share) - large - i].copy()
        for start in range(min(i, len(share))):
            share[start::i] = np.cumsum(share[start::i])
        share *= np.longdouble(i) / (large + i)
    return np.cumsum(share).astype(float)


@pandas_udf(DoubleType())
def u_two_sided(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_sum: pd.Series, kind: pd.Series) -> pd.Series:
    """Two-sided p of the U statistic, of the ``kind`` that the first row names.

    ``asymptotic``: normal with tie and continuity correction. ``exact``: null with
    ties. ``auto``: exact without ties when the smaller group has at most 8 values.
    """
    stat, a, b, ties = (s.to_numpy(dtype=float) for s in (u, n1, n2, tie_sum))
    n = a + b
    high = np.maximum(stat, a * b - stat)
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.sqrt(a * b / 12.0 * ((n + 1.0) - ties / (n * (n - 1.0))))
        z = (high - a * b / 2.0 - 0.5) / sd
    p = np.clip(_erfc(z / math.sqrt(2.0)), 0.0, 1.0)
    rule = kind.iloc[0] if len(kind) else "auto"
    exact = (ties == 0) & ~np.isnan(stat) & ((np.minimum(a, b) <= 8) | (rule == "exact")) & (rule != "asymptotic")
    if rule == "exact":
        p[ties != 0] = np.nan
    for pair in {(int(x), int(y)) for x, y in zip(a[exact], b[exact])}:
        rows = exact & (a == pair[0]) & (b == pair[1])
        # the distribution is symmetric, so the upper tail is a lower one of at most half its length
        low = (pair[0] * pair[1] - high[rows]).round().astype(int)
        p[rows] = np.minimum(1.0, 2.0 * rank_sum_lower(*pair, int(low.max()))[low])
    return pd.Series(p)


@pandas_udf(DoubleType())
def overlap_upper(x: pd.Series, m: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= x) when k of n genes are drawn and m of the n are marked (hypergeometric).

    The probability of x itself comes from log factorials, the following ones
    from the ratio of neighbours.
    """
    x, m, k, n = (s.to_numpy(dtype=float) for s in (x, m, k, n))
    choose = lambda a, b: _lgamma(a + 1.0) - _lgamma(b + 1.0) - _lgamma(a - b + 1.0)
    low = np.maximum(x, np.maximum(0.0, m + k - n))
    high = np.minimum(m, k)
    possible = low <= high
    at = np.where(possible, low, 0.0)
    term = np.zeros(len(x))
    ok = possible & (n >= m) & (n >= k)
    term[ok] = np.exp(choose(m[ok], at[ok]) + choose(n[ok] - m[ok], k[ok] - at[ok]) - choose(n[ok], k[ok]))
    total, i, live = term.copy(), at.copy(), ok & (at < high)
    while live.any():
        j = i[live]
        term[live] *= (m[live] - j) * (k[live] - j) / ((j + 1.0) * (n[live] - m[live] - k[live] + j + 1.0))
        total[live] += term[live]
        i[live] += 1.0
        live &= (i < high) & ~((term < total * 1e-18) & (i * n > m * k))
    # everything at or below the smallest possible overlap has probability 1
    total = np.where(x <= np.maximum(0.0, m + k - n), 1.0, np.minimum(total, 1.0))
    return pd.Series(np.where(n >= np.maximum(m, k), total, np.nan))
