"""Distribution functions.

The normal one is a column expression (no Python worker); the chi-square, t and F ones serve test statistics, a few
rows a model, and are plain Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_two_sided(x: float) -> float:
    return math.erfc(abs(x) / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function, by series below a + 1 and continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        step = 1.0
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            step = d * c
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_quantile_two_sided(level: float, df: float) -> float:
    """The t beyond which both tails together hold `level`."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > level else (low, mid)
    return (low + high) / 2


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function of a column: a series near 0, a continued fraction beyond (1e-13)."""
    a = F.least(F.abs(x), F.lit(38.0))
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("term"), a.alias("sum")),
        lambda acc, n: F.struct((acc["term"] * a * a / (2 * n + 1)).alias("term"), (acc["sum"] + acc["term"] * a * a / (2 * n + 1)).alias("sum")),
        lambda acc: acc["sum"],
    )
    tail = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(80))), a, lambda acc, n: a + n / acc)
    upper = F.when(a < 3, 0.5 - density * series).otherwise(density / tail)
    return F.when(x.isNull(), F.lit(None)).when(x > 0, 1 - upper).otherwise(upper)
