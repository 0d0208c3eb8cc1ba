"""Tails and quantiles of the t, chi-square and normal distributions.

They run on result rows (one for each group), as vectorised UDFs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z_95 = NormalDist().inv_cdf(0.975)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, dof: float) -> float:
    half = 0.5 * beta_cdf(dof / 2, 0.5, dof / (dof + t * t))
    return half if t >= 0 else 1 - half


def t_quantile(p: float, dof: float) -> float:
    """Bisection on the upper tail; p is the lower-tail probability."""
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    low, high = 0.0, 1.0
    while t_sf(high, dof) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if t_sf(mid, dof) > 1 - p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        step = c * d
        out *= step
        if abs(step - 1) < 1e-16:
            break
    return front * out


def chi2_sf(x: float, dof: float) -> float:
    return math.erfc(math.sqrt(x / 2)) if dof == 1 else gamma_sf(dof / 2, x / 2)


def _by_value(f, *cols: pd.Series) -> pd.Series:
    """``f`` of each distinct row, dealt to the rows; null where an input is."""
    known = pd.concat(cols, axis=1).astype("float64")
    ok = known.notna().all(axis=1).to_numpy()
    values, back = np.unique(known.to_numpy()[ok], axis=0, return_inverse=True)
    out = np.full(len(ok), np.nan)
    out[ok] = np.array([f(*v) for v in values.tolist()], float)[back.reshape(-1)] if len(values) else []
    return pd.Series(out).where(ok, None)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _by_value(lambda a, b: 2 * t_sf(abs(a), b) if b > 0 else math.nan, t, dof)


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, dof: pd.Series) -> pd.Series:
    return _by_value(lambda a, b: t_quantile(a, b) if b > 0 else math.nan, p, dof)


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _by_value(chi2_sf, x, dof)


def wilson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson interval for k of n, inside [0, 1]; null where n isn't positive."""
    z = normal_quantile(1 - alpha / 2)
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(F.greatest(p * (1 - p) / n + z * z / (4 * n * n), F.lit(0.0))) / base
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half))


def wilson_upper(k: Column, n: Column, z: float = Z_95) -> Column:
    """Upper Wilson limit; 1 where n isn't positive."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    high = (p + z * z / (2 * m) + z * F.sqrt(F.greatest(p * (1 - p) / m + z * z / (4 * m * m), F.lit(0.0)))) / (1 + z * z / m)
    return F.coalesce(F.least(F.lit(1.0), high), F.lit(1.0))
