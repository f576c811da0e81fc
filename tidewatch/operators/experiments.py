"""Results of an experiment grid: means, intervals, paired comparisons (AG22, JN15, ST25, MX18). A group is the runs of one setting: as many as seeds."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """AG22: runs, mean and sample deviation of each value by setting."""
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), *[f(v).alias(f"{v}_{k}") for v in values for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])


@lru_cache
def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's t for p >= 1/2, by bisection of its distribution (Simpson's rule over the density)."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(x: float) -> float:
        t = np.linspace(0, x, 4001)
        y = c * (1 + t * t / df) ** (-(df + 1) / 2)
        return 0.5 + x / 12000 * float(y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def mean_interval(rows: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """ST25: (*by, runs, mean, half): the mean of each setting and half its t interval; null for a single run."""
    g = rows.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))

    @F.udf("double")
    def quantile(n):  # one call a setting
        return t_quantile((1 + level) / 2, n - 1) if n and n > 1 else None

    return g.select(*by, "runs", "mean", (quantile("runs") * F.col("sd") / F.sqrt("runs")).alias("half"))


def signed_rank(d: np.ndarray) -> tuple[float, float]:
    """ST25: Wilcoxon's signed-rank statistic (the lesser sum) and its two-sided p of differences, zeros dropped: exact up to 50 without ties, else by the normal approximation with tie correction."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    size, at, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[at]
    up = float(rank[d > 0].sum())
    w = min(up, n * (n + 1) / 2 - up)
    if n <= 50 and (count == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return w, min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48
    return w, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """JN15, ST25: one row: runs that two settings share, by key, the mean difference, the signed-rank statistic and p."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).select(F.lit(1).alias("g"), (F.col("x") - F.col("y")).alias("d"))

    def run(pdf):  # noqa: ANN001
        import pandas as pd

        w, p = signed_rank(pdf["d"].to_numpy(float))
        return pd.DataFrame({"runs": [len(pdf)], "mean_difference": [float(pdf["d"].mean())], "w": [w], "p": [p]})

    return j.groupBy("g").applyInPandas(run, "runs long, mean_difference double, w double, p double")


def new_campaigns(log: DataFrame) -> DataFrame:
    """MX18: (update, new): campaigns of each update that continue none of the one before, (1 - continuity) of them."""
    return log.select("update", ((1 - F.col("continuity")) * F.col("campaigns")).alias("new"))
