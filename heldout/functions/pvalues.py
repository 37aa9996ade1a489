"""Tail probabilities that SQL lacks.  Used on pair tables and single rows."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.DoubleType())
def _erfc(v: pd.Series) -> pd.Series:
    return v.map(lambda a: math.erfc(a) if a == a else float("nan")).astype("float64")


def two_sided_normal(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    return _erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def fisher_z_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation, variance inflated by 1.06; 1 when n <= 3."""
    clipped = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), rho))
    z = F.atanh(clipped) * F.sqrt((n - F.lit(3.0)) / F.lit(1.06))
    return F.when(n <= 3, F.lit(1.0)).otherwise(two_sided_normal(F.when(n <= 3, F.lit(0.0)).otherwise(z)))


#: Where each method is used: rows of the matrix, and n d^2 from which both sides together are rarer than a double tells.
MATRIX_SCENES, BOTH_SIDES = 20_000, 4.0


def kolmogorov_p(d: float, n: int, method: str = "exact") -> float:
    """P(D_n >= d) for the one-sample statistic.

    ``exact`` is right to 1e-8 or better at any n, by bounded work (the choice follows
    Simard and L'Ecuyer, 2011): from n d^2 = 4 twice the exact one-sided probability;
    below, the matrix form of Marsaglia, Tsang and Wang (2003), of fewer than 4 sqrt(n)
    rows, up to MATRIX_SCENES; beyond, the expansion of Pelz and Good (1976).
    ``limit``: the limit law at Stephens' corrected argument.
    """
    if n <= 0 or d != d:
        return float("nan")
    if d <= 0.5 / n:
        return 1.0
    if d >= 1.0:
        return 0.0
    if method not in ("exact", "limit"):
        raise ValueError("method is exact or limit")
    if method == "exact":
        if n * d * d >= BOTH_SIDES:
            return float(min(1.0, 2 * _one_sided(d, n)))
        return float(min(1.0, max(0.0, 1.0 - (_exact_cdf(d, n) if n <= MATRIX_SCENES else _pelz_good(d, n)))))
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    j = np.arange(1, 101, dtype=float)
    if x < 1.18:
        odd = 2 * j - 1
        cdf = math.sqrt(2 * math.pi) / x * np.exp(-odd ** 2 * math.pi ** 2 / (8 * x * x)).sum()
        return float(min(1.0, max(0.0, 1.0 - cdf)))
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (j - 1) * np.exp(-2 * j * j * x * x)).sum())))


def _one_sided(d: float, n: int) -> float:
    """P(D_n^+ >= d): a sum of positive terms, in logarithms, over the terms that a double can tell."""
    j = np.arange(0, int(n * (1 - d)) + 1, dtype=float)
    j = j[(1 - d - j / n) > 0]
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=float)))])
    at = j.astype(int)
    logs = factorials[n] - factorials[at] - factorials[n - at] + (j - 1) * np.log(d + j / n) + (n - j) * np.log1p(-(d + j / n))
    return d * math.fsum(np.exp(logs[logs > -745.0]))


def _pelz_good(d: float, n: int) -> float:
    """P(D_n < d) by the expansion in 1 / sqrt(n) with four terms; the coefficients are those of the paper (fixed values)."""
    z = d * math.sqrt(n)
    z2, z4, z6, p2 = z ** 2, z ** 4, z ** 6, math.pi ** 2
    h = (np.arange(-60, 60) + 0.5) ** 2 * p2                     # pi^2 (k + 1/2)^2
    w = np.arange(-60, 61) ** 2 * p2                             # pi^2 k^2
    eh, ew = np.exp(-h / (2 * z2)), np.exp(-w / (2 * z2))
    root = math.sqrt(math.pi / 2)
    k0 = 2 * root / z * eh[60:].sum()
    k1 = root / (6 * z4) * ((h - z2) * eh).sum()
    k2 = root / (72 * z ** 7) * ((6 * z6 + 2 * z4 + (2 * z4 - 5 * z2) * h + (1 - 2 * z2) * h ** 2) * eh).sum() - root / (36 * z ** 3) * (w * ew).sum()
    k3 = root / (6480 * z ** 10) * (((5 - 30 * z2) * h ** 3 + (-60 * z2 + 212 * z4) * h ** 2 + (135 * z4 - 96 * z6) * h - 30 * z6 - 90 * z ** 8) * eh).sum() \
        + root / (108 * z6) * ((3 * w * z2 - w ** 2) * ew).sum()
    return k0 + k1 / math.sqrt(n) + k2 / n + k3 / n ** 1.5


def _exact_cdf(d: float, n: int) -> float:
    k = int(math.ceil(n * d))
    h = k - n * d
    m = 2 * k - 1
    i, j = np.indices((m, m))
    base = (i - j + 1 >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    base[:, 0] -= powers
    base[-1, :] -= powers[::-1]
    if 2 * h - 1 > 0:
        base[-1, 0] += (2 * h - 1) ** m
    gap = np.clip(i - j + 1, 0, None)
    factorial = np.array([math.factorial(g) if g < 171 else math.inf for g in range(m + 1)], float)
    base /= factorial[gap]
    # Power by squaring, with the scale carried apart so nothing overflows.
    result, scale = np.eye(m), 0
    square, square_scale, e = base, 0, n
    while e:
        if e & 1:
            result, scale = result @ square, scale + square_scale
        square, square_scale = square @ square, 2 * square_scale
        top = np.abs(square).max()
        if top > 1e100:
            square, square_scale = square * 1e-100, square_scale + 100
        if np.abs(result).max() > 1e100:
            result, scale = result * 1e-100, scale + 100
        e >>= 1
    logs = math.log(max(result[k - 1, k - 1], 1e-320)) + scale * math.log(10)
    return math.exp(min(0.0, logs + math.lgamma(n + 1) - n * math.log(n)))
