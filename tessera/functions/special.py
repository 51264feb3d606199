"""Special functions. Those that Spark has are its own; the rest are Arrow-batched and vectorised."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.elementwise import NAN, log, num

sin, cos, tan, asin, acos, atan = (lambda f: [lambda x, g=g: g(num(x)) for g in f])([F.sin, F.cos, F.tan, F.asin, F.acos, F.atan])
exp, expm1, cbrt = (lambda f: [lambda x, g=g: g(num(x)) for g in f])([F.exp, F.expm1, F.cbrt])


def atan2(y, x):
    return F.atan2(num(y), num(x))


def exp2(x):
    return F.pow(F.lit(2.0), num(x))


ln = log


def log10(x):
    return log(x) / F.lit(math.log(10.0))


def log2(x):
    return log(x) / F.lit(math.log(2.0))


def log1p(x):
    x = num(x)
    return F.when(F.isnan(x) | (x < -1), F.lit(NAN)).when(x == -1, F.lit(-float("inf"))).otherwise(F.log1p(F.when(x > -1, x)))


def pow(x, y):  # noqa: A001
    return F.pow(num(x), num(y))


def sinpi(x):
    """sin(pi x), exact at multiples of a half."""
    r = num(x) - F.lit(2.0) * F.round(num(x) / F.lit(2.0))
    return F.when(r == F.floor(r), F.lit(0.0)).when(F.abs(r) == 0.5, F.signum(r)).otherwise(F.sin(F.lit(math.pi) * r))


def cospi(x):
    """cos(pi x), exact at multiples of a half."""
    r = F.abs(num(x) - F.lit(2.0) * F.round(num(x) / F.lit(2.0)))
    return F.when(r == 0.5, F.lit(0.0)).when(r == 1.0, F.lit(-1.0)).when(r == 0.0, F.lit(1.0)).otherwise(F.cos(F.lit(math.pi) * r))


def each(f):
    """A function of a NumPy array over Arrow batches. pandas has one sign for null and not-a-number: these are told apart
    outside of it."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(f(x.to_numpy(float)))

    return lambda x: F.when(x.isNotNull(), F.when(F.isnan(x), F.lit(NAN)).otherwise(F.coalesce(run(x), F.lit(NAN))))


#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)) for k from 1 (fixed values).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _log_gamma_positive(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log gamma of x + n by Stirling's series, n steps up to at least 12, and the product of x to x + n - 1, for x > 0."""
    low, product = x.copy(), np.ones_like(x)
    for _ in range(12):
        small = low < 12
        product[small] *= low[small]
        low[small] += 1
    series = sum(c / low ** (2 * k + 1) for k, c in enumerate(STIRLING))
    return (low - 0.5) * np.log(low) - low + 0.5 * math.log(2 * math.pi) + series, product


def _gamma(x: np.ndarray) -> np.ndarray:
    out = np.where(x == np.inf, np.inf, np.nan)
    up = (x > 0) & (x < np.inf)
    logs, product = _log_gamma_positive(np.minimum(x[up], 200.0))
    out[up] = np.exp(logs) / product
    whole = up & (x == np.floor(x)) & (x < 24)
    out[whole] = np.round(out[whole])
    low = (x < 0) & (x != np.floor(x))
    logs, product = _log_gamma_positive(np.minimum(1 - x[low], 200.0))
    turn = np.sin(np.pi * np.mod(x[low], 2.0))
    out[low] = np.pi / (turn * np.exp(logs) / product)
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    out = np.full(x.shape, np.inf)
    up = (x > 0) & (x < np.inf)
    logs, product = _log_gamma_positive(x[up])
    out[up] = logs - np.log(product)
    low = (x < 0) & (x != np.floor(x))
    logs, product = _log_gamma_positive(1 - x[low])
    out[low] = math.log(math.pi) - np.log(np.abs(np.sin(np.pi * np.mod(x[low], 2.0)))) - (logs - np.log(product))
    return np.where(np.isnan(x), np.nan, out)


def _erfc_tail(x: np.ndarray) -> np.ndarray:
    """erfc for x >= 2 by its continued fraction, from the inside out."""
    t = x.copy()
    for k in range(120, 0, -1):
        t = x + (k / 2) / t
    return np.exp(-x * x) / (t * math.sqrt(math.pi))


def _erf_core(x: np.ndarray) -> np.ndarray:
    """erf for |x| < 2 by a series whose terms have one sign."""
    term, total = x.copy(), x.copy()
    for k in range(1, 60):
        term = term * (2 * x * x / (2 * k + 1))
        total = total + term
    return 2 / math.sqrt(math.pi) * np.exp(-x * x) * total


def _erfc(x: np.ndarray) -> np.ndarray:
    far = np.clip(np.abs(x), 2.0, 40.0)
    tail = np.where(np.abs(x) > 40, 0.0, _erfc_tail(far))
    near = 1 - _erf_core(np.clip(x, -2.0, 2.0))
    return np.where(np.isnan(x), np.nan, np.where(np.abs(x) < 2, near, np.where(x > 0, tail, 2 - tail)))


def _erf(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 2, _erf_core(np.clip(x, -2.0, 2.0)), 1 - _erfc(x))


#: Arguments up to which Bessel functions are integrated.
NEAR = 50.0


def bessel_integral(n: int, x: np.ndarray) -> np.ndarray:
    """J_n for |x| up to max(NEAR, n) by the trapezoidal rule on its integral over a period, which converges faster than any
    power of the step; the steps depend on n alone."""
    steps = int(2 * (max(NEAR, n) + n)) + 64
    t = (np.arange(steps) + 0.5) * math.pi / steps
    out = np.zeros(x.shape)
    for a in range(0, steps, 64):
        part = t[a : a + 64]
        out += np.cos(n * part[None, :] - x[:, None] * np.sin(part)[None, :]).sum(1)
    return out / steps


def _bessel_far(n: int, x: np.ndarray) -> np.ndarray:
    """J_n for x > max(NEAR, n): Hankel's expansion of J_0 and J_1, then the recurrence, stable up to the argument."""

    def hankel(m: int) -> np.ndarray:
        p, q, term = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
        for k in range(1, 20):
            term = term * ((4 * m * m - (2 * k - 1) ** 2) / (k * 8 * x))
            sign = -1 if k // 2 % 2 else 1
            if k % 2:
                q = q + sign * term
            else:
                p = p + sign * term
        turn = x - (m / 2 + 0.25) * math.pi
        return np.sqrt(2 / (math.pi * x)) * (p * np.cos(turn) - q * np.sin(turn))

    before, now = hankel(0), hankel(1)
    if n == 0:
        return before
    for k in range(1, n):
        before, now = now, 2 * k / x * now - before
    return now


def _bessel(n: int, x: np.ndarray) -> np.ndarray:
    """J_n of each value by itself: 0 at infinity."""
    out = np.where(np.isnan(x), np.nan, 0.0)
    near = np.abs(x) <= max(NEAR, n)
    out[near] = bessel_integral(n, x[near])
    far = ~near & np.isfinite(x)
    out[far] = _bessel_far(n, np.abs(x[far])) * (np.sign(x[far]) if n % 2 else 1.0)
    return out


def bessel_j(n: int, x) -> Column:
    """Bessel function of the first kind of an integer order."""
    sign = -1.0 if n < 0 and n % 2 else 1.0

    return each(lambda v: sign * _bessel(abs(n), v))(num(x))


def bessel_j0(x):
    return bessel_j(0, x)


def bessel_j1(x):
    return bessel_j(1, x)


def bessel_i0(x) -> Column:
    return each(lambda v: np.where(np.abs(v) > 720, np.where(np.isnan(v), np.nan, np.inf), np.i0(np.clip(v, -720, 720))))(num(x))


def gamma(x):
    """Not a number at the poles."""
    return each(_gamma)(num(x))


def log_gamma(x):
    """log |gamma(x)|, infinite at the poles."""
    return each(_lgamma)(num(x))


def erf(x):
    return each(_erf)(num(x))


def erfc(x):
    return each(_erfc)(num(x))


def cdf_norm(x):
    """The standard normal distribution function."""
    return each(_erfc)(num(x) * F.lit(-1.0 / math.sqrt(2.0))) * 0.5


cdfnorm = cdf_norm
