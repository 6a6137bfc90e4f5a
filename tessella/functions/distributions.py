"""Distribution functions as pandas UDFs, for the last step of a test: one value for each result row, never for each input row.

Regularised incomplete beta and gamma functions by continued fractions and series, in NumPy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.session import ship


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_regularised(a, b, x) -> np.ndarray:
    """I_x(a, b), by the continued fraction on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (y > 0) & (y < 1)
    y = np.where(inside, y, 0.5)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.clip(front * h, 0, 1)
    value = np.where(inside, value, np.where(np.where(flip, 1 - x, x) <= 0, 0.0, 1.0))
    return np.where(flip, 1 - value, value)


def gamma_upper(a, x) -> np.ndarray:
    """Q(a, x), by series below a + 1 and by continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    z = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(z) - z - log_gamma(a))
    term = total = 1 / a
    rounds = 1000 + int(20 * math.sqrt(np.max(a, initial=0)))  # near x = a both take some multiple of the root of a
    for n in range(1, rounds):
        term = term * z / (a + n)
        total = total + term
        if np.all(np.abs(term) < 1e-16 * np.abs(total)):
            break
    b = z + 1 - a
    c, d = np.full_like(z, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d.copy()
    for n in range(1, rounds):
        k = -n * (n - a)
        b = b + 2
        d = 1 / (k * d + b)
        c = b + k / c
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


@F.pandas_udf(DoubleType())
def _normal_sf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def _chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    ok = x.notna() & (df > 0)
    return pd.Series(np.where(ok, gamma_upper(df.where(ok, 1) / 2, x.where(ok, 1) / 2), np.nan))


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & (df > 0)
    d = df.where(ok, 1)
    return pd.Series(np.where(ok, beta_regularised(d / 2, 0.5, d / (d + t.where(ok, 0) ** 2)), np.nan))


@F.pandas_udf(DoubleType())
def _f_sf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    ok = x.notna() & (a > 0) & (b > 0)
    p, q, v = a.where(ok, 1), b.where(ok, 1), x.where(ok, 0).clip(lower=0)
    return pd.Series(np.where(ok, beta_regularised(q / 2, p / 2, q / (q + p * v)), np.nan))


@F.pandas_udf(DoubleType())
def _binomial_two_sided(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """The sum of all outcomes that are not likelier than the one seen."""

    def one(k, n, p):
        if pd.isna(k) or pd.isna(n):
            return None
        x = np.arange(int(n) + 1)
        with np.errstate(divide="ignore"):
            logs = math.lgamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1) + x * np.log(p) + (n - x) * np.log1p(-p)
        pmf = np.exp(logs)
        return float(min(1.0, pmf[pmf <= pmf[int(k)] * (1 + 1e-7)].sum()))

    return pd.Series([one(*v) for v in zip(k, n, p, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _hypergeometric_sf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(at least k marked among those drawn)."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    def run(start, stop, step, total, marked, drawn):
        """Terms beyond `start` up to `stop` as shares of the one at `start`, until what is left cannot change the sum."""
        out, last, size = 0.0, 1.0, 64
        while start != stop and last > 0:
            i = start + step * np.arange(min(size, abs(stop - start)))
            up = (marked - i) * (drawn - i) / ((i + 1) * (total - marked - drawn + i + 1)) if step > 0 else i * (total - marked - drawn + i) / ((marked - i + 1) * (drawn - i + 1))
            shares = last * np.cumprod(up)
            out += shares.sum()
            start, last, size = start + step * len(i), shares[-1], 2 * size
            if up[-1] < 1 and last / (1 - up[-1]) < 1e-18 * (1 + out):  # the quotients fall, so the rest is below this
                break
        return out

    def one(k, total, marked, drawn):
        top = int(min(marked, drawn))
        low = int(max(k, drawn - (total - marked), 0))
        if low > top:
            return 0.0
        mode = min(max(int((marked + 1) * (drawn + 1) / (total + 2)), low), top)
        peak = math.exp(choose(marked, mode) + choose(total - marked, drawn - mode) - choose(total, drawn))
        return min(1.0, peak * (1 + run(mode, top, 1, total, marked, drawn) + run(mode, low, -1, total, marked, drawn)))

    return pd.Series([None if pd.isna(a) else one(a, b, c, e) for a, b, c, e in zip(k, total, marked, drawn, strict=True)], dtype="float64")


def _here() -> None:
    """The tasks of the session in use can import this package."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def normal_sf(z: Column) -> Column:
    _here()
    return _normal_sf(z.cast("double"))


def chi2_sf(x: Column, df: Column) -> Column:
    _here()
    return _chi2_sf(x.cast("double"), df.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    _here()
    return _t_two_sided(t.cast("double"), df.cast("double"))


def f_sf(x: Column, a: Column, b: Column) -> Column:
    _here()
    return _f_sf(x.cast("double"), a.cast("double"), b.cast("double"))


def binomial_two_sided(k: Column, n: Column, p: Column) -> Column:
    _here()
    return _binomial_two_sided(k.cast("double"), n.cast("double"), p.cast("double"))


def hypergeometric_sf(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    _here()
    return _hypergeometric_sf(*(c.cast("double") for c in (k, total, marked, drawn)))
