"""Special functions: column expressions where elementary, Arrow UDFs where not."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The UDFs travel with their code, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Asymptotic series in 1/x^2 of digamma and trigamma (Bernoulli numbers).
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)
SHIFT = 8


def _powers(terms, x):
    """terms[0] + terms[1] x + ... by Horner's rule; works on numbers and columns."""
    total = terms[-1]
    for t in reversed(terms[:-1]):
        total = total * x + t
    return total


def _horner(terms, x: Column) -> Column:
    return _powers([F.lit(float(t)) for t in terms], x)


def digamma(x: Column) -> Column:
    z = x + SHIFT
    r = F.lit(1.0) / (z * z)
    head = sum((F.lit(1.0) / (x + i) for i in range(1, SHIFT)), F.lit(1.0) / x)
    return F.ln(z) - F.lit(0.5) / z + r * _horner(DIGAMMA_SERIES, r) - head


def trigamma(x: Column) -> Column:
    z = x + SHIFT
    r = F.lit(1.0) / (z * z)
    head = sum((F.lit(1.0) / ((x + i) * (x + i)) for i in range(1, SHIFT)), F.lit(1.0) / (x * x))
    return F.lit(1.0) / z + r / 2 + r / z * _horner(TRIGAMMA_SERIES, r) + head


def np_digamma(x):
    z = x + SHIFT
    r = 1 / (z * z)
    head = sum(1 / (x + i) for i in range(SHIFT))
    return np.log(z) - 0.5 / z + r * _powers(DIGAMMA_SERIES, r) - head


def np_trigamma(x):
    z = x + SHIFT
    r = 1 / (z * z)
    return 1 / z + r / 2 + r / z * _powers(TRIGAMMA_SERIES, r) + sum(
        1 / (x + i) ** 2 for i in range(SHIFT)
    )


def _np_tetragamma(x, h=1e-5):
    step = h * x
    return (np_trigamma(x + step) - np_trigamma(x - step)) / (2 * step)


def np_trigamma_inverse(target):
    """x with trigamma(x) = target, and where that holds: for positive numbers on which Newton's
    steps on 1/trigamma settle."""
    ok = target > 0
    goal = np.where(ok, target, 1.0)
    x = 0.5 + 1 / goal
    for _ in range(200):
        tri = np_trigamma(x)
        step = tri * (1 - tri / goal) / _np_tetragamma(x)
        x = np.maximum(x + step, x / 4)
        if np.all(np.abs(step) <= 1e-13 * x):
            break
    return x, ok & (np.abs(step) <= 1e-10 * x)


@F.pandas_udf(T.DoubleType())
def trigamma_inverse(v: pd.Series) -> pd.Series:
    """x with trigamma(x) = v, for v > 0; NULL otherwise."""
    x, ok = np_trigamma_inverse(v.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(np.where(ok, x, np.nan)).astype("Float64").mask(~ok)


# Stirling series of ln gamma in 1/x^2.
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def _stirling_tail(z):
    return _powers(LGAMMA_SERIES, 1 / (z * z)) / z


def _np_lgamma(x):
    z = x + SHIFT
    shift = np.log(np.prod([x + i for i in range(SHIFT)], axis=0))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + _stirling_tail(z) - shift


def _np_lgamma_step(x, h):
    """ln gamma(x + h) - ln gamma(x) without the cancellation of two large values."""
    z = x + SHIFT
    step = (z - 0.5) * np.log1p(h / z) + h * np.log(z + h) - h
    shift = sum(np.log1p(h / (x + i)) for i in range(SHIFT))
    return step + _stirling_tail(z + h) - _stirling_tail(z) - shift


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function, evaluated from the left by
    tracking ratios of successive convergents."""
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    num = np.ones_like(x)
    den = 1 / guard(1 - (a + b) * x / (a + 1))
    out, m, open_ = den.copy(), 0, True
    while open_:  # about as many steps as the root of the larger parameter
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            den = 1 / guard(1 + coef * den)
            num = guard(1 + coef / num)
            delta = den * num
            out = out * delta
        open_ = bool(np.any(np.abs(delta - 1) >= 1e-15))
    return out


def beta_inc(a, b, x, y):
    """Regularised incomplete beta I_x(a, b) for arrays, with y = 1 - x given exactly."""
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x, y)))
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    u, w = np.where(flip, y, x), np.where(flip, x, y)
    high, low = np.maximum(p, q), np.minimum(p, q)
    with np.errstate(divide="ignore", invalid="ignore"):
        ln_u = np.where(u > 0.5, np.log1p(-w), np.log(u))
        ln_w = np.where(w > 0.5, np.log1p(-u), np.log(w))
        front = np.exp(p * ln_u + q * ln_w + _np_lgamma_step(high, low) - _np_lgamma(low))
    part = np.where(u <= 0, 0.0, front * _beta_fraction(p, q, u) / p)
    return np.where(flip, 1 - part, part)


ERFC_SPLIT, ERFC_TERMS = 2.0, 100


def _erfc(x):
    """Complementary error function of non-negative arrays: the series of erf with positive
    terms below ERFC_SPLIT, the continued fraction above."""
    x = np.asarray(x, dtype=float)
    out, small = np.empty(x.shape), x < ERFC_SPLIT
    low = x[small]
    square = 2 * low * low
    term, total = low, low.copy()
    for n in range(1, ERFC_TERMS):
        term = term * (square / (2 * n + 1))
        total += term
        if not np.any(term > 1e-18 * total):
            break
    out[small] = 1 - 2 / math.sqrt(math.pi) * np.exp(-square / 2) * total
    high = x[~small]
    tail = high
    for n in range(ERFC_TERMS, 0, -1):
        tail = high + n / 2 / tail
    out[~small] = np.exp(-high * high) / (math.sqrt(math.pi) * tail)
    return out


def _nullable(values, ok) -> pd.Series:
    return pd.Series(np.where(ok, values, 0.0)).astype("Float64").mask(~ok)


def np_t_two_sided(tv, dv):
    """Two-sided tail of Student's t; infinite df is the normal limit, NaN stays NaN."""
    tv, dv = np.broadcast_arrays(np.asarray(tv, float), np.asarray(dv, float))
    p = np.full(tv.shape, np.nan)
    ok = ~(np.isnan(tv) | np.isnan(dv)) & (dv > 0)
    normal = ok & (dv > 1e9)
    finite = ok & ~normal
    if finite.any():
        d, sq = dv[finite], tv[finite] ** 2
        p[finite] = beta_inc(d / 2, 0.5, d / (d + sq), sq / (d + sq))
    if normal.any():
        p[normal] = _erfc(np.abs(tv[normal]) / math.sqrt(2))
    return p


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """The same for columns; NULL stays NULL."""
    p = np_t_two_sided(*(v.to_numpy(dtype=float, na_value=np.nan) for v in (t, df)))
    return _nullable(p, ~np.isnan(p))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """2 * Phi(-|z|)."""
    zv = z.to_numpy(dtype=float, na_value=np.nan)
    ok = ~np.isnan(zv)
    return _nullable(_erfc(np.abs(np.where(ok, zv, 0.0)) / math.sqrt(2)), ok)


@F.pandas_udf(T.DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= k) for X ~ Binomial(n, 1/2)."""
    kv = k.to_numpy(dtype=float, na_value=np.nan)
    nv = n.to_numpy(dtype=float, na_value=np.nan)
    ok = ~(np.isnan(kv) | np.isnan(nv))
    inner = ok & (kv >= 1) & (kv <= nv)
    a = np.where(inner, kv, 1.0)
    b = np.where(inner, nv - kv + 1, 1.0)
    p = beta_inc(a, b, 0.5, 0.5)
    return _nullable(np.where(inner, p, np.where(kv <= 0, 1.0, 0.0)), ok)


def binomial_tail(n: int) -> list[float]:
    """P(X >= k), k = 0..n, for X ~ Binomial(n, 1/2), from exact integers."""
    tail, upper = [], 0
    for k in range(n, -1, -1):
        upper += math.comb(n, k)
        tail.append(upper / 2**n)
    return tail[::-1]


def binomial_tail_table(spark: SparkSession, n: int) -> DataFrame:
    """Lookup ``(hits, binom_p_value)`` of n + 1 rows; n is the number of imputations."""
    rows = list(enumerate(binomial_tail(n)))
    return spark.createDataFrame(rows, "hits long, binom_p_value double")


def smallest_significant(n: int, level: float = 0.05) -> int | None:
    """Fewest hits out of n with a one-sided binomial p-value below ``level``."""
    for k, p in enumerate(binomial_tail(n)):
        if p < level:
            return k
    return None
