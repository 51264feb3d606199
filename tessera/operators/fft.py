"""Discrete Fourier transforms: NumPy on packed arrays, or joins and sums over the long form for partly known arrays."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tessera.grid import Grid, ShapeError

NORMS = {"none": (None, None), "forward": ("forward", None), "inverse": (None, "backward"), "orthonormal": ("ortho", "ortho")}


def _scale(n: int, inverse: bool, norm: str) -> float:
    if norm == "orthonormal":
        return 1 / math.sqrt(n)
    return 1 / n if norm == ("inverse" if inverse else "forward") else 1.0


def transform(g: Grid, axes: tuple[int, ...] | None = None, inverse: bool = False, norm: str = "inverse", centered: bool = False) -> Grid:
    """Over the axes given (all if none); norm says which direction is divided by the number of points: none, forward,
    inverse, or both by its root (orthonormal). centered shifts to and from the middle."""
    axes = tuple(range(g.rank)) if axes is None else axes
    n = math.prod(g.shape[d] for d in axes)
    factor = _scale(n, inverse, norm) * (n if inverse else 1)

    over = tuple(d + 1 for d in axes)  # the first axis counts the arrays of a batch

    def f(x: np.ndarray) -> np.ndarray:
        if centered:
            x = np.fft.ifftshift(x, over)
        y = (np.fft.ifftn if inverse else np.fft.fftn)(x, axes=over) * factor
        return np.fft.fftshift(y, over) if centered else y

    return g.kernel(f, g.shape, True, batched=True)


def fft(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (g.rank - 1,), False, norm)


def ifft(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (g.rank - 1,), True, norm)


def fft2(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (g.rank - 2, g.rank - 1), False, norm)


def ifft2(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (g.rank - 2, g.rank - 1), True, norm)


def fft3(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (0, 1, 2), False, norm)


def ifft3(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (0, 1, 2), True, norm)


def fft3_centered(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (0, 1, 2), False, norm, True)


def ifft3_centered(g: Grid, norm: str = "inverse") -> Grid:
    return transform(g, (0, 1, 2), True, norm, True)


fft2_batch, ifft2_batch = fft2, ifft2


def fft3_batch(g: Grid, norm: str = "inverse", inverse: bool = False) -> Grid:
    """Volumes along the last axis of a rank-4 array."""
    return transform(g, (0, 1, 2), inverse, norm)


def fft_segmented(g: Grid, segments: int, inverse: bool = False, norm: str = "inverse") -> Grid:
    """Each of `segments` equal parts of a vector by itself."""
    n = g.shape[-1]
    if n % segments:
        raise ShapeError(f"{segments} segments do not divide {n} points")
    m = n // segments
    factor = _scale(m, inverse, norm) * (m if inverse else 1)
    f = lambda x: (np.fft.ifft if inverse else np.fft.fft)(x.reshape(len(x), segments, m), axis=2) * factor
    return g.kernel(f, g.shape, True, batched=True)


def ifft_segmented(g: Grid, segments: int, norm: str = "inverse") -> Grid:
    return fft_segmented(g, segments, True, norm)


def dft_axis(g: Grid, dim: int, inverse: bool = False, scale: float = 1.0) -> Grid:
    """One axis by its definition: each element is spread over the n frequencies and summed. n rows an element, so for short
    axes; elements that are absent count as 0."""
    n = g.shape[dim]
    c = g.index[dim]
    step = (2 if inverse else -2) * math.pi / n
    re, im = (F.col("re"), F.col("im")) if g.is_complex else (F.col("v"), F.lit(0.0))
    angle = F.lit(step) * F.pmod(F.col(c) * F.col("f"), F.lit(n))
    cos, sin = F.cos(angle), F.sin(angle)
    df = g.df.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    others = [x for x in g.index if x != c]
    out = df.groupBy(*g.keys, *others, F.col("f").alias(c)).agg((F.sum(re * cos - im * sin) * scale).alias("re"), (F.sum(re * sin + im * cos) * scale).alias("im"))
    return replace(g, df=out.select(*g.keys, *g.index, "re", "im"), is_complex=True)


def dft2(g: Grid, inverse: bool = False) -> Grid:
    """Two separable passes; the inverse is divided by the number of points."""
    a, b = g.rank - 2, g.rank - 1
    return dft_axis(dft_axis(g, b, inverse, 1 / g.shape[b] if inverse else 1.0), a, inverse, 1 / g.shape[a] if inverse else 1.0)


def _conv(g: Grid, kernel: np.ndarray, mode: str, flip: bool) -> Grid:
    k = np.asarray(kernel)
    k = np.conj(k[::-1, ::-1]) if flip else k
    (r, c), (kr, kc) = g.shape, k.shape
    full = (r + kr - 1, c + kc - 1)
    shape = {"full": full, "same": (r, c), "valid": (r - kr + 1, c - kc + 1)}[mode]
    if min(shape) < 1:
        raise ShapeError("the kernel is larger than the input")
    a = {"full": (0, 0), "same": ((kr - 1) // 2, (kc - 1) // 2), "valid": (kr - 1, kc - 1)}[mode]
    z = g.is_complex or np.iscomplexobj(k)

    def f(x: np.ndarray) -> np.ndarray:
        y = np.fft.ifft2(np.fft.fft2(x, full) * np.fft.fft2(k, full))[:, a[0] : a[0] + shape[0], a[1] : a[1] + shape[1]]
        return y if z else y.real

    return g.kernel(f, shape, z, batched=True)


def convolve2d_fft(g: Grid, kernel: np.ndarray, mode: str = "full") -> Grid:
    """full, same (the centre of the full result) or valid."""
    return _conv(g, kernel, mode, False)


def correlate2d_fft(g: Grid, kernel: np.ndarray, mode: str = "full") -> Grid:
    return _conv(g, kernel, mode, True)
