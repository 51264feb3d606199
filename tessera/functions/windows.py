"""Window and filter curves: expressions of an index column i from 0 for n points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.elementwise import num

PI = math.pi


def _cosines(p: Column, a: float, b: float, c: float = 0.0) -> Column:
    return F.lit(a) - F.lit(b) * F.cos(p) + F.lit(c) * F.cos(2.0 * p)


SHAPES = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}


def window(i: Column, n: int, kind: str = "hann") -> Column:
    """rectangular, hann, hamming or blackman, symmetric."""
    if kind == "rectangular" or n == 1:
        return F.lit(1.0)
    return _cosines(i * F.lit(2 * PI / (n - 1)), *SHAPES[kind])


def _half(i: Column, length: int) -> Column:
    return i * F.lit(PI / (length - 1))


def half_hann_filter(i: Column, length: int) -> Column:
    return _cosines(_half(i, length), *SHAPES["hann"])


def half_hamming_filter(i: Column, length: int) -> Column:
    return _cosines(_half(i, length), *SHAPES["hamming"])


def half_blackman_filter(i: Column, length: int) -> Column:
    return _cosines(_half(i, length), *SHAPES["blackman"])


def hamming_bandpass_filter(i: Column, length: int) -> Column:
    return _cosines(2.0 * _half(i, length), *SHAPES["hamming"])


def dual_hamming_bandpass_filter(i: Column, length: int, start: int = 0) -> Column:
    """Two Hamming lobes, each of half the length."""
    half = length // 2
    if half <= 1:
        raise ValueError("dual_hamming_bandpass_filter needs a length over two")
    k = F.when(i + start < half, i).otherwise(i - half)
    return _cosines(k * F.lit(2 * PI / (half - 1)), *SHAPES["hamming"])


def triangle_filter(i: Column, length: int, start: int = 0) -> Column:
    return (F.lit(length // 2) - (i + start)) * F.lit(2.0) / F.lit(float(length - 1))


def hbrr_filter(i: Column, length: int) -> Column:
    s = F.sin(_half(i, length))
    return s * (2.0 - s)


def tukey_window(i: Column, n: int, ratio: float) -> Column:
    if ratio <= 0 or n == 1:
        return F.lit(1.0)
    if ratio >= 1:
        return window(i, n, "hann")
    last, edge = float(n - 1), ratio * (n - 1) / 2
    rise = 0.5 * (1.0 + F.cos(PI * (2.0 * i / F.lit(ratio * last) - 1.0)))
    fall = 0.5 * (1.0 + F.cos(PI * (2.0 * i / F.lit(ratio * last) - F.lit(2.0 / ratio - 1.0))))
    return F.when(i < edge, rise).when(i <= last - edge, F.lit(1.0)).otherwise(fall)


def tukey_filter(i: Column, ratio: float, length: int) -> Column:
    if ratio <= 0:
        return F.lit(1.0)
    last = float(length - 1)
    if ratio >= 1:
        return 0.5 * (1.0 - F.cos(2 * PI * i / F.lit(last)))
    low = math.floor(ratio / 2 * last) + 1
    high = length - low + 1
    k = PI / (ratio / 2)
    rise = 0.5 * (1.0 + F.cos(F.lit(k) * (i / F.lit(last) - F.lit(ratio / 2))))
    fall = 0.5 * (1.0 + F.cos(F.lit(k) * (i / F.lit(last) - F.lit(1.0 - ratio / 2))))
    return F.when(i < low, rise).when(i >= high, fall).otherwise(F.lit(1.0))


def exponential_window(i: Column, n: int, alpha: float, exponent: float = 2.0) -> Column:
    u = (i - F.lit((n - 1) / 2)) / F.lit(float(max(n - 1, 1)))
    return F.exp(-F.lit(float(alpha)) * F.pow(F.abs(u), F.lit(float(exponent))))


def exponential_filter(i: Column, length: int, alpha: float, exponent: float) -> Column:
    u = (i - F.lit(length / 2)) / F.lit(float(length))
    return F.exp(F.pow(u, F.lit(float(exponent))) * F.lit(-float(alpha)))


def fermi_edge(d: Column, radius: float, width: float) -> Column:
    return 1.0 / (1.0 + F.exp((d - F.lit(float(radius))) / F.lit(float(width))))


def _positive(name: str, width: float) -> None:
    if width <= 0:
        raise ValueError(f"{name}: width must be positive")


def fermi_window(i: Column, n: int, radius: float, width: float) -> Column:
    _positive("fermi_window", width)
    return fermi_edge(F.abs(i - F.lit((n - 1) / 2)), radius, width)


def fermi_filter(i: Column, length: int, radius: float, width: float) -> Column:
    _positive("fermi_filter", width)
    return fermi_edge(F.abs(i - F.lit(length / 2)), radius, width)


def fermi_bandpass_window(i: Column, n: int, low: float, high: float, width: float) -> Column:
    """High pass at the low radius times low pass at the high one."""
    _positive("fermi_bandpass_window", width)
    if low < 0 or high <= low:
        raise ValueError("fermi_bandpass_window needs 0 <= low < high")
    d = F.abs(i - F.lit((n - 1) / 2))
    return 1.0 / (1.0 + F.exp((F.lit(float(low)) - d) / F.lit(float(width)))) * fermi_edge(d, high, width)


def dual_fermi_band_window(i: Column, n: int, offset: float, radius: float, width: float) -> Column:
    """The larger of two bands, left and right of the centre."""
    _positive("dual_fermi_band_window", width)
    if offset < 0 or radius < 0:
        raise ValueError("dual_fermi_band_window needs an offset and a radius of at least 0")
    c = (n - 1) / 2
    return F.greatest(fermi_edge(F.abs(i - F.lit(c - offset)), radius, width), fermi_edge(F.abs(i - F.lit(c + offset)), radius, width))


def quadratic_exponential_window(i: Column, n: int, radius: float, factor: float) -> Column:
    off = i - F.lit(n / 2)
    return F.exp(off * off * F.lit(factor / (n * radius) ** 2))


quadratic_exponential_filter = quadratic_exponential_window


def t2_linear_filter(i: Column, start: int, step: float, center: int) -> Column:
    return (i + F.lit(start - center)) * num(step) + 1.0


def t2_exponential_filter(i: Column, start: int, spacing: float, center: int, decay: float) -> Column:
    if decay == 0:
        raise ValueError("t2_exponential_filter: decay must not be 0")
    return F.exp((F.lit(center - start) - i) * F.lit(spacing / decay))


def cosine_laplacian_denominator(row: Column, col: Column, dimension: int) -> Column:
    if dimension == 0:
        raise ValueError("cosine_laplacian_denominator: dimension must not be 0")
    return 2.0 * (F.cos(row * F.lit(PI / dimension)) + F.cos(col * F.lit(PI / dimension)) - 2.0)
