"""Exact confidence intervals. Their quantiles have no closed form, so these are Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function for a > 0, x > 0: a power series below a + 1, Lentz's continued fraction above."""
    front = np.exp(a * np.log(x) - x - _lgamma(a).astype(float))
    low = x < a + 1
    out = np.empty_like(x)
    p, q = a[low], x[low]
    term = total = 1 / p
    n = 0
    while term.size and (term > total * 1e-16).any():
        n += 1
        term = term * q / (p + n)
        total = total + term
    out[low] = total * front[low]
    p, q = a[~low], x[~low]
    b = q + 1 - p
    c, d = np.full_like(q, 1e300), 1 / b
    f, n, change = d, 0, np.full_like(q, 2.0)
    while change.size and (np.abs(change - 1) > 1e-15).any() and n < 100_000:
        n += 1
        k = n * (p - n)
        b = b + 2
        d = 1 / (k * d + b)
        c = b + k / c
        change = c * d
        f = f * change
    out[~low] = 1 - f * front[~low]
    return out


def gamma_quantile(a: np.ndarray, p: float) -> np.ndarray:
    """x with gamma_cdf(a, x) = p, by bisection between bounds that hold it."""
    lo, hi = np.zeros_like(a), a + 20 * np.sqrt(a) + 20
    for _ in range(80):
        mid = (lo + hi) / 2
        above = gamma_cdf(a, mid) > p
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return (lo + hi) / 2


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    each = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return min(1.0, math.fsum(map(math.exp, each)))


def proportion_bounds(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson bounds of a proportion: the extremes under which k of n is not in a tail of (1 - level) / 2."""
    tail, out = (1 - level) / 2, []
    for hits, want in ((k, tail), (k + 1, 1 - tail)):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if binomial_tail(hits, n, mid) > want else (mid, hi)
        out.append((lo + hi) / 2)
    return (0.0 if k == 0 else out[0]), (1.0 if k == n else out[1])


def rate_bounds(count: Column, time: Column, level: float = 0.95) -> Column:
    """A struct (lo, hi): Garwood's exact interval of a Poisson rate from a count over a time of 1 at least. Null counts give null bounds."""
    tail = (1 - level) / 2

    @F.pandas_udf("lo double, hi double")
    def bounds(k: pd.Series, t: pd.Series) -> pd.DataFrame:
        n = k.to_numpy(float, na_value=np.nan)
        known = np.unique(n[~np.isnan(n)])
        lo = dict(zip(known, np.where(known > 0, gamma_quantile(np.maximum(known, 1), tail), 0.0)))
        hi = dict(zip(known, gamma_quantile(known + 1, 1 - tail)))
        time = np.maximum(t.to_numpy(float, na_value=np.nan), 1)
        return pd.DataFrame({"lo": [lo.get(x) for x in n], "hi": [hi.get(x) for x in n]}, dtype=float).div(time, axis=0)

    return bounds(count, time)
