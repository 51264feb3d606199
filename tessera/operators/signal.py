"""Signals (rank-1 grids): convolutions, recursive and rank filters, phase, resampling."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import elementwise as el
from tessera.functions import windows as win
from tessera.grid import Grid, constants
from tessera.operators import arrays, image


def window(spark, n: int, kind: str = "hann") -> Grid:
    return constants(spark, (n,), lambda lin, i: win.window(i, n, kind) + F.lit(0.0))


def curve(spark, n: int, f) -> Grid:
    """A window or filter of functions.windows over n points: f(i)."""
    return constants(spark, (n,), lambda lin, i: f(i) + F.lit(0.0))


def _taps(taps) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(taps)])


def convolve(g: Grid, kernel) -> Grid:
    """Full convolution, n + k - 1 points."""
    rows = g.df.select(*g.keys, "i0", *g.values, F.explode(_taps(kernel)).alias("o"))
    df = rows.groupBy(*g.keys, (F.col("i0") + F.col("o.k")).cast("int").alias("i0")).agg(*[F.sum(F.col("o.t") * F.col(c)).alias(c) for c in g.values])
    return replace(g, df=df, shape=(g.shape[0] + len(kernel) - 1,))


def fir_filter(g: Grid, taps) -> Grid:
    """Causal, with nothing before the first sample."""
    return arrays.crop(convolve(g, taps), (0,), g.shape)


def iir_filter(g: Grid, numerator, denominator) -> Grid:
    """y[i] = (sum b x - sum of later a y) / a0 from rest: a scan of one packed signal."""
    b, a = np.asarray(numerator, float), np.asarray(denominator, float)
    if a[0] == 0:
        raise ValueError("iir_filter: the first denominator coefficient must not be 0")

    def f(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for i in range(len(x)):
            v = sum(b[k] * x[i - k] for k in range(min(len(b), i + 1)))
            v -= sum(a[k] * y[i - k] for k in range(1, min(len(a), i + 1)))
            y[i] = v / a[0]
        return y

    return g.kernel(f, g.shape, g.is_complex)


def median_filter(g: Grid, k: int, border: str = "replicate") -> Grid:
    """Median of k (odd) samples; border replicate, zero, or causal_replicate (the k last samples)."""
    if k % 2 == 0:
        raise ValueError("median_filter: the kernel size must be odd")
    lead = k - 1 if border == "causal_replicate" else k // 2
    offs = F.explode(F.sequence(F.lit(-lead), F.lit(k - 1 - lead)))
    asked = g.df.select(*g.keys, "i0", offs.alias("o")).withColumn("p", F.col("i0") + F.col("o"))
    asked = asked.withColumn("p", image.border_index(F.col("p"), g.shape[0], "constant" if border == "zero" else "replicate"))
    source = g.df.select(*g.keys, F.col("i0").alias("p"), "v")
    df = asked.join(source, [*g.keys, "p"], "left").groupBy(*g.keys, "i0").agg(F.median(F.coalesce("v", F.lit(0.0))).alias("v"))
    return replace(g, df=df)


def causal_median(df: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """df with v: the median of a row and the k - 1 before it, fewer at the start."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), 0)
    near = F.array_sort(F.collect_list(value).over(w))
    n = F.size("near")
    mid = (F.element_at("near", F.floor((n + 1) / 2).cast("int")) + F.element_at("near", F.floor((n + 2) / 2).cast("int"))) / 2
    return df.withColumn("near", near).withColumn("v", mid).drop("near")


def convolve2d_full(g: Grid, kernel) -> Grid:
    k = np.asarray(kernel, float)
    offs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.lit(float(k[i, j])).alias("w")) for i in range(k.shape[0]) for j in range(k.shape[1])])
    rows = g.df.select(*g.keys, "i0", "i1", *g.values, F.explode(offs).alias("o"))
    df = rows.groupBy(*g.keys, (F.col("i0") + F.col("o.a")).cast("int").alias("i0"), (F.col("i1") + F.col("o.b")).cast("int").alias("i1")).agg(*[F.sum(F.col("o.w") * F.col(c)).alias(c) for c in g.values])
    return replace(g, df=df, shape=(g.shape[0] + k.shape[0] - 1, g.shape[1] + k.shape[1] - 1))


def correlate2d_same(g: Grid, kernel) -> Grid:
    """Zero border, the kernel's middle k // 2, not flipped."""
    return image.filter2d(g, kernel, "constant")


def convolve2d_same(g: Grid, kernel) -> Grid:
    k = np.asarray(kernel, float)
    full = convolve2d_full(g, k)
    return arrays.crop(full, ((k.shape[0] - 1) // 2, (k.shape[1] - 1) // 2), g.shape)


def compose_separable_kernel(row, col) -> np.ndarray:
    return np.outer(np.asarray(row, float), np.asarray(col, float))


def correlate2d_same_separable(g: Grid, row, col) -> Grid:
    return correlate2d_same(correlate2d_same(g, np.asarray(col, float)[None, :]), np.asarray(row, float)[:, None])


def normal_equation_without_index(g: Grid, excluded: int) -> tuple[Grid, Grid]:
    """A square normal matrix without one row and column, and the column that went as the right side."""
    n = g.shape[0]
    less = lambda c: F.when(F.col(c) > excluded, F.col(c) - 1).otherwise(F.col(c))
    inner = g.reindex((n - 1, n - 1), (F.col("i0") != excluded) & (F.col("i1") != excluded), less("i0"), less("i1"))
    rhs = g.reindex((n - 1,), (F.col("i0") != excluded) & (F.col("i1") == excluded), less("i0"))
    return inner, rhs


# ---------------------------------------------------------------- phase
def wrap_phase(g: Grid, limit: float = math.pi) -> Grid:
    return g.map(lambda v: el.wrap_phase(v, limit))


def unwrapped(df: DataFrame, keys: list[str], order: list[str], value: str, discontinuity: float = math.pi) -> DataFrame:
    """df with its value made continuous: a raw step over the discontinuity turns all that follows by 2 pi."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.col(value) - F.lag(value).over(w)
    turn = F.when(step > discontinuity, F.lit(-1)).when(step < -discontinuity, F.lit(1)).otherwise(F.lit(0))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("turn", turn).withColumn(value, F.col(value) + F.sum("turn").over(run) * F.lit(2 * math.pi)).drop("turn")


def unwrap_phase(g: Grid, discontinuity: float = math.pi) -> Grid:
    return replace(g, df=unwrapped(g.df, list(g.keys), ["i0"], "v", discontinuity))


def unwrap_phase_2d(g: Grid, discontinuity: float = math.pi) -> Grid:
    """Along each row, then along each column."""
    rows = unwrapped(g.df, [*g.keys, "i0"], ["i1"], "v", discontinuity)
    return replace(g, df=unwrapped(rows, [*g.keys, "i1"], ["i0"], "v", discontinuity))


def unwrap_phase_laplacian_2d(g: Grid) -> Grid:
    """The least-squares phase: Poisson's equation for the wrapped differences, solved by cosine transforms."""
    rows, cols = g.shape

    def dct(x: np.ndarray, axis: int, inverse: bool) -> np.ndarray:
        n = x.shape[axis]
        k = np.cos(np.pi * np.outer(np.arange(n), np.arange(n) + 0.5) / n)
        m = (k.T * np.where(np.arange(n) == 0, 1.0, 2.0)) / n if inverse else k
        return np.moveaxis(np.tensordot(m, x, (1, axis)), 0, axis)

    def f(x: np.ndarray) -> np.ndarray:
        wrap = lambda d: np.angle(np.exp(1j * d))
        dy, dx = wrap(np.diff(x, axis=0)), wrap(np.diff(x, axis=1))
        rho = np.zeros(x.shape)
        rho[:-1] += dy
        rho[1:] -= dy
        rho[:, :-1] += dx
        rho[:, 1:] -= dx
        t = dct(dct(rho, 0, False), 1, False)
        den = 2 * (np.cos(np.pi * np.arange(rows) / rows)[:, None] + np.cos(np.pi * np.arange(cols) / cols)[None, :] - 2)
        den[0, 0] = 1.0
        t = t / den
        t[0, 0] = 0.0
        y = dct(dct(t, 0, True), 1, True)
        return y - y[0, 0] + x[0, 0]

    return g.kernel(f, g.shape)


def resample(g: Grid, m: int, kind: str = "linear") -> Grid:
    """Ends on ends: nearest, linear, cubic, mitchell or lanczos3, borders replicated."""
    return image.resample_axis(g, 0, m, kind)
