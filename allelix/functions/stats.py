"""Tail probabilities and small estimators, vectorised in numpy, and as Spark functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = float(np.finfo(float).tiny)
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        f = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < TINY, TINY, d)
                c = 1 + num / np.where(np.abs(c) < TINY, TINY, c)
                f *= c * d
            if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
                break
        out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * f))
    return np.where(swap, 1 - out, out)


def student_p(t, df) -> np.ndarray:
    """Two-sided p of Student's t; NaN where df is not positive; never 0."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(all="ignore"):
        p = beta_inc(np.where(df > 0, df, 1) / 2, 0.5, df / (df + t * t))
    return np.where((df > 0) & np.isfinite(t), np.clip(p, TINY, 1), np.nan)


def normal_sf(z) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def chi2_sf(x, df) -> np.ndarray:
    """Upper tail of chi-square, by series or continued fraction of the incomplete gamma function."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    a, z = df / 2, np.maximum(x, 0) / 2
    with np.errstate(all="ignore"):
        lead = np.exp(a * np.log(z) - z - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for k in range(1, 1000):
            term = term * z / (a + k)
            total += term
            if np.nanmax(np.where(z < a + 1, term / total, 0), initial=0) < 1e-16:
                break
        low = 1 - lead * total
        b = z + 1 - a
        c, d = np.full_like(z, 1 / TINY), 1 / np.where(np.abs(b) < TINY, TINY, b)
        h = d.copy()
        for k in range(1, 500):
            num = -k * (k - a)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = b + num / np.where(np.abs(c) < TINY, TINY, c)
            h *= c * d
            if np.nanmax(np.abs(np.where(z >= a + 1, c * d - 1, 0)), initial=0) < 1e-15:
                break
        out = np.where(z <= 0, 1.0, np.where(z < a + 1, low, lead * h))
    return np.clip(out, 0, 1)


def golden_min(f, low: float, high: float, tol: float = 1e-8, steps: int = 200) -> float:
    """Minimum of a unimodal function on an interval, by golden sections with parabolic steps."""
    r = (3 - math.sqrt(5)) / 2
    x = w = v = low + r * (high - low)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(steps):
        mid, t = (low + high) / 2, tol * abs(x) + 1e-12
        if abs(x - mid) <= 2 * t - (high - low) / 2:
            break
        golden = True
        if abs(e) > t:
            p = (x - w) * (fx - fv)
            q = (x - v) * (fx - fw)
            num, den = (x - v) * q - (x - w) * p, 2 * (q - p)
            num, den = (-num, den) if den > 0 else (num, -den)
            if abs(num) < abs(den * e / 2) and den * (low - x) < num < den * (high - x):
                e, d, golden = d, num / den, False
        if golden:
            e = (high - x) if x < mid else (low - x)
            d = r * e
        u = x + (d if abs(d) >= t else math.copysign(t, d))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (low, u) if u >= x else (u, high)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def golden_min_many(f, m: int, low: float, high: float, tol: float = 1e-8, steps: int = 200) -> np.ndarray:
    """``golden_min`` for m functions side by side: ``f`` takes the numbers of those still searched and a point for each."""
    r = (3 - math.sqrt(5)) / 2
    lo, hi = np.full(m, float(low)), np.full(m, float(high))
    x = lo + r * (hi - lo)
    w, v, d, e = x.copy(), x.copy(), np.zeros(m), np.zeros(m)
    left = np.arange(m)
    fx = np.asarray(f(left, x), float)
    fw, fv = fx.copy(), fx.copy()
    for _ in range(steps):
        t = tol * np.abs(x[left]) + 1e-12
        far = np.abs(x[left] - (lo[left] + hi[left]) / 2) > 2 * t - (hi[left] - lo[left]) / 2
        left, t = left[far], t[far]
        if not len(left):
            break
        a, b, X, W, V, FX, FW, FV, D, E = (z[left] for z in (lo, hi, x, w, v, fx, fw, fv, d, e))
        p, q = (X - W) * (FX - FV), (X - V) * (FX - FW)
        num, den = (X - V) * q - (X - W) * p, 2 * (q - p)
        num, den = np.where(den > 0, -num, num), np.abs(den)
        bent = (np.abs(E) > t) & (np.abs(num) < np.abs(den * E / 2)) & (den * (a - X) < num) & (num < den * (b - X))
        E = np.where(bent, D, np.where(X < (a + b) / 2, b - X, a - X))
        D = np.where(bent, num / np.where(den > 0, den, 1.0), r * E)
        u = X + np.where(np.abs(D) >= t, D, np.copysign(t, D))
        fu = np.asarray(f(left, u), float)
        better, up = fu <= FX, u >= X
        lo[left] = np.where(better, np.where(up, X, a), np.where(up, a, u))
        hi[left] = np.where(better, np.where(up, b, X), np.where(up, u, b))
        second = ~better & ((fu <= FW) | (W == X))
        third = ~better & ~second & ((fu <= FV) | (V == X) | (V == W))
        v[left], fv[left] = np.where(better | second, W, np.where(third, u, V)), np.where(better | second, FW, np.where(third, fu, FV))
        w[left], fw[left] = np.where(better, X, np.where(second, u, W)), np.where(better, FX, np.where(second, fu, FW))
        x[left], fx[left], d[left], e[left] = np.where(better, u, X), np.where(better, fu, FX), D, E
    return x


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_p(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series(np.clip(2 * normal_sf(np.abs(z.to_numpy(float))), TINY, 1))


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.maximum(chi2_sf(x.to_numpy(float), df.to_numpy(float)), TINY))


def neglog10(p: Column) -> Column:
    """-log10 of a p-value; values that are not in (0, 1] count as 1 or as the smallest double."""
    p = F.when(p.isNull() | F.isnan(p) | (p > 1), 1.0).otherwise(F.greatest(p, F.lit(TINY)))
    return -F.log10(p)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null where a variance is 0.  In doubles, as products of whole sums leave 64 bits."""
    n, sx, sy, sxx, syy, sxy = (c.cast("double") for c in (n, sx, sy, sxx, syy, sxy))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    den = F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy))
    return (n * sxy - sx * sy) / den
