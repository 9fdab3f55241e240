"""Tail probabilities of test statistics (scalars only), from the commons-math
library on Spark's class path."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import SparkSession

from postlytics.session import get_spark


def _special():
    spark = SparkSession.getActiveSession() or get_spark()
    return spark._jvm.org.apache.commons.math3.special


def _missing(x: float | None) -> bool:
    return x is None or math.isnan(x)


def chi2_sf(x: float, k: float) -> float:
    if _missing(x):
        return float("nan")
    return _special().Gamma.regularizedGammaQ(k / 2, x / 2) if x > 0 else 1.0


def f_sf(x: float, d1: float, d2: float) -> float:
    if _missing(x) or d2 <= 0:
        return float("nan")
    return _special().Beta.regularizedBeta(d2 / (d2 + d1 * x), d2 / 2, d1 / 2) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    if _missing(t) or df <= 0:
        return float("nan")
    return _special().Beta.regularizedBeta(df / (df + t * t), df / 2, 0.5)


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def lilliefors_p(d: float, n: int) -> float:
    """Approximate p-value of the Lilliefors normality test (mean and sd
    estimated), Dallal-Wilkinson (1986) formula, which holds for p <= 0.1; a larger
    value only says that p is above 0.1."""
    if n < 5 or _missing(d):
        return float("nan")
    if n > 100:
        d = d * (n / 100.0) ** 0.49
        n = 100
    p = math.exp(-7.01256 * d * d * (n + 2.78019) + 2.99587 * d * math.sqrt(n + 2.78019)
                 - 0.122119 + 0.974598 / math.sqrt(n) + 1.67997 / n)
    return min(max(p, 0.0), 1.0)
