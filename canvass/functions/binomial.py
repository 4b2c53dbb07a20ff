"""Exact binomial tail probability for grouped rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variance from which the tail is an integral over the smooth mass function.
SMOOTH_VARIANCE = 1e6
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """log n! less its Stirling approximation."""
    n = np.asarray(n, float)
    small = np.minimum(n, 16.0)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    exact = gamma(small + 1) - (small + 0.5) * np.log(np.maximum(small, 1e-300)) + small - 0.5 * math.log(2 * math.pi)
    m = np.maximum(n, 1.0) ** 2
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m) / m) / m) / m) / np.maximum(n, 1.0)
    return np.where(n > 15, series, exact)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x without cancellation."""
    x, mean = np.broadcast_arrays(np.asarray(x, float), np.asarray(mean, float))
    v = (x - mean) / (x + mean)
    near = np.abs(v) < 0.1
    s, term = (x - mean) * v, 2 * x * v
    for j in range(1, 30):
        term = term * v * v
        s = s + term / (2 * j + 1)
    far = x * np.log(np.maximum(x, 1e-300) / mean) + mean - x
    return np.where(near, s, far)


def mass(x: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Binomial probability of x, also between whole numbers (saddle-point form)."""
    x, n = np.broadcast_arrays(np.asarray(x, float), np.asarray(n, float))
    inner = (x > 0) & (x < n)
    y = np.where(inner, x, n / 2)
    log = _stirling_rest(n) - _stirling_rest(y) - _stirling_rest(n - y) - _deviance(y, n * p) - _deviance(n - y, n * (1 - p))
    out = np.exp(log) * np.sqrt(n / np.maximum(2 * math.pi * y * (n - y), 1e-300))
    edge = np.where(x == 0, np.exp(n * math.log1p(-p)), np.where(x == n, np.exp(n * math.log(p)), 0.0))
    return np.where(inner, out, edge)


def _smooth_tail(k: float, n: float, p: float) -> float:
    """P(X >= k) for k above the mean: midpoint sums are integrals up to 1 / variance^2."""
    sigma = math.sqrt(n * p * (1 - p))
    start, end = k - 0.5, min(k - 0.5 + 40 * sigma, n + 0.5)
    edges = np.linspace(start, end, 81)
    half = np.diff(edges) / 2
    x = (edges[:-1] + half)[:, None] + half[:, None] * _NODES
    total = float((mass(x, n, p) * _WEIGHTS * half[:, None]).sum())
    step = sigma * 1e-3
    low, high = mass(np.array([start - step, start + step]), n, p)
    return total + float(high - low) / (2 * step) / 24


def upper_tail(k: np.ndarray, n: np.ndarray, p0: float) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, p0).

    Large variances: quadrature of the mass function.  Others: the incomplete beta as a continued
    fraction (modified Lentz), evaluated on the side where it converges fast.
    """
    k, n = np.asarray(k, float), np.asarray(n, float)
    out = np.where(k <= 0, 1.0, 0.0)
    inside = (k > 0) & (k <= n)
    smooth = inside & (n * p0 * (1 - p0) >= SMOOTH_VARIANCE)
    for i in np.flatnonzero(smooth):
        if k[i] > n[i] * p0:
            out[i] = _smooth_tail(k[i], n[i], p0)
        else:
            out[i] = 1 - _smooth_tail(n[i] - k[i] + 1, n[i], 1 - p0)
    inside &= ~smooth
    if inside.any():
        out[inside] = _fraction_tail(k[inside], n[inside], p0)
    return np.clip(out, 0.0, 1.0)


def _fraction_tail(k: np.ndarray, n: np.ndarray, p0: float) -> np.ndarray:
    a, b = k, n - k + 1
    swap = p0 > (a + 1) / (a + b + 2)
    aa, bb = np.where(swap, b, a), np.where(swap, a, b)
    x = np.where(swap, 1 - p0, p0)
    front = np.where(swap, mass(k - 1, n, p0) * p0, mass(k, n, p0) * (1 - p0))
    tiny = 1e-300
    c = np.ones_like(aa)
    d = 1 / _away_from_zero(1 - (aa + bb) * x / (aa + 1), tiny)
    h = d.copy()
    for m in range(1, 100_000):
        even = m * (bb - m) * x / ((aa + 2 * m - 1) * (aa + 2 * m))
        d = 1 / _away_from_zero(1 + even * d, tiny)
        c = _away_from_zero(1 + even / c, tiny)
        h = h * d * c
        odd = -(aa + m) * (aa + bb + m) * x / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1 / _away_from_zero(1 + odd * d, tiny)
        c = _away_from_zero(1 + odd / c, tiny)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    else:
        raise ArithmeticError("the binomial tail did not converge")
    tail = front * h
    return np.where(swap, 1 - tail, tail)


def _away_from_zero(v: np.ndarray, tiny: float) -> np.ndarray:
    return np.where(np.abs(v) < tiny, tiny, v)


def binomial_p_value(k: Column, n: Column, p0: float = 0.5) -> Column:
    """One-sided p-value column; meant for aggregated rows, not for raw ones."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(upper_tail(k.to_numpy(), n.to_numpy(), p0))

    return tail(k, n)
