"""Complex numbers as pairs of columns (re, im). Functions take and give pairs; real results are one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.elementwise import divide, num

Pair = tuple[Column, Column]


def real(re, im):
    return re


def imag(re, im):
    return im


def split_complex(re, im) -> Pair:
    return re, im


def complex_from_real_imag(re, im) -> Pair:
    return num(re), num(im)


def complex_from_real(re) -> Pair:
    return num(re), F.lit(0.0)


def magnitude(re, im):
    return F.hypot(re, im)


def squared_magnitude(re, im):
    return re * re + im * im


def phase(re, im):
    return F.atan2(im, re)


arg = phase


def conjugate(re, im) -> Pair:
    return re, -im


conj = conjugate


def add(a, b, c, d) -> Pair:
    return a + c, b + d


def subtract(a, b, c, d) -> Pair:
    return a - c, b - d


def multiply(a, b, c, d) -> Pair:
    """(a + ib)(c + id)."""
    return a * c - b * d, a * d + b * c


def multiply_conjugate(a, b, c, d) -> Pair:
    """The first by the conjugate of the second."""
    return a * c + b * d, b * c - a * d


def divide_complex(a, b, c, d) -> Pair:
    m = c * c + d * d
    return divide(a * c + b * d, m), divide(b * c - a * d, m)


def scale(re, im, s) -> Pair:
    return re * num(s), im * num(s)


def exp(re, im) -> Pair:
    return F.exp(re) * F.cos(im), F.exp(re) * F.sin(im)


def soft_threshold(re, im, lam, eps=1e-9) -> Pair:
    """The magnitude drawn towards 0 by lam; 0 where it is below eps."""
    m = F.hypot(re, im)
    k = F.when(m < eps, F.lit(0.0)).otherwise(F.greatest(m - num(lam), F.lit(0.0)) / F.when(m < eps, F.lit(1.0)).otherwise(m))
    return re * k, im * k


def normalize_complex_phase(re, im) -> Pair:
    """z / |z|, not a number at 0."""
    m = F.hypot(re, im)
    return divide(re, m), divide(im, m)


def complex_unit_phasor(re, im, eps=0.0) -> Pair:
    """z / |z| where |z| > eps, else 0."""
    m = F.hypot(re, im)
    safe = F.when(m > eps, m).otherwise(F.lit(1.0))
    return F.when(m > eps, re / safe).otherwise(F.lit(0.0)), F.when(m > eps, im / safe).otherwise(F.lit(0.0))


def reflect_complex_about(a, b, c, d) -> Pair:
    """2 Re(z conj(r)) r - z with r the unit phasor of c + id."""
    m = F.hypot(c, d)
    r, i = divide(c, m), divide(d, m)
    k = 2.0 * (a * r + b * i)
    return k * r - a, k * i - b


def absolute_phase_difference(a, b, c, d):
    re, im = multiply_conjugate(a, b, c, d)
    return F.abs(F.atan2(im, re))


def rectangular_to_polar(re, im) -> Pair:
    """magnitude and phase."""
    return F.hypot(re, im), F.atan2(im, re)


rectangular_to_polar_components = rectangular_to_polar


def polar_to_rectangular(m, p) -> Pair:
    return m * F.cos(p), m * F.sin(p)


def unit_phasor(p) -> Pair:
    return F.cos(p), F.sin(p)


def conjugate_product_scaled(pr, pi, sr, si, s) -> Pair:
    """conj(phase) signal s."""
    return (pr * sr + pi * si) * num(s), (pr * si - pi * sr) * num(s)


def accumulate_conjugate_product_scaled(ar, ai, pr, pi, sr, si, s) -> Pair:
    x, y = conjugate_product_scaled(pr, pi, sr, si, s)
    return ar + x, ai + y


def accumulate_conjugate_product_divided(ar, ai, pr, pi, sr, si, d) -> Pair:
    x, y = conjugate_product_scaled(pr, pi, sr, si, 1.0)
    return ar + divide(x, d), ai + divide(y, d)


def replace_nan(re, im, value) -> Pair:
    return F.nanvl(re, num(value)), F.nanvl(im, num(value))


def isfinite(re, im):
    ok = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return ok(re) & ok(im)
