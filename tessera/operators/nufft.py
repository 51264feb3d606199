"""Non-uniform Fourier transforms by their definition, and gridding of radial samples.

k-space coordinates are radians a pixel; the origin of an image is its middle ((rows - 1) / 2, (cols - 1) / 2).
"""

from __future__ import annotations

import math


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.grid import Grid
from tessera.operators.fft import transform


def _spread(df: DataFrame, rows: int, cols: int) -> DataFrame:
    return df.withColumn("i0", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("i1", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))


def _angle(rows: int, cols: int, sign: float) -> Column:
    return F.lit(sign) * (F.col("k_row") * (F.col("i0") - F.lit((rows - 1) / 2)) + F.col("k_col") * (F.col("i1") - F.lit((cols - 1) / 2)))


def forward(image: Grid, trajectory: DataFrame) -> DataFrame:
    """keys, sample, re, im: the image at each point of trajectory (sample, k_row, k_col, and keys to match if it has them).

    Each point meets each pixel of its own frame, by an equi-join on the pixels after spreading the points over them."""
    rows, cols = image.shape
    shared = [k for k in image.keys if k in trajectory.columns]
    both = _spread(trajectory, rows, cols).join(image.df, [*shared, "i0", "i1"])
    re, im = (F.col("re"), F.col("im")) if image.is_complex else (F.col("v"), F.lit(0.0))
    c, s = F.cos(_angle(rows, cols, -1.0)), F.sin(_angle(rows, cols, -1.0))
    return both.groupBy(*image.keys, "sample").agg(F.sum(re * c - im * s).alias("re"), F.sum(re * s + im * c).alias("im"))


def adjoint(samples: DataFrame, keys: tuple[str, ...], rows: int, cols: int) -> Grid:
    """The unweighted adjoint of samples (keys, k_row, k_col, re, im)."""
    df = _spread(samples, rows, cols)
    c, s = F.cos(_angle(rows, cols, 1.0)), F.sin(_angle(rows, cols, 1.0))
    out = df.groupBy(*keys, "i0", "i1").agg(F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("re") * s + F.col("im") * c).alias("im"))
    return Grid(out, (rows, cols), tuple(keys), True)


direct_nudft2_forward = nufft2_forward = forward
direct_nudft2_adjoint = nufft2_adjoint = adjoint


def radial_analytic_ramp_dcf2(k_row: Column, k_col: Column) -> Column:
    """Density compensation of radial samples: the distance from the centre."""
    return F.hypot(k_row, k_col)


def linear_gridding(samples: DataFrame, keys: tuple[str, ...], rows: int, cols: int) -> Grid:
    """Samples (keys, k_row, k_col, re, im), weighted by w if there is one, put on the periodic frequency grid: each on the
    four points around it, in proportion, with the phase of the image's origin."""
    pos = lambda k, n: F.col(k) * F.lit(n / (2 * math.pi))
    df = samples.withColumns({"pr": pos("k_row", rows), "pc": pos("k_col", cols)})
    phase = F.lit(-1.0) * (F.col("k_row") * F.lit((rows - 1) / 2) + F.col("k_col") * F.lit((cols - 1) / 2))
    w = F.col("w") if "w" in samples.columns else F.lit(1.0)
    df = df.withColumns({"zr": w * (F.col("re") * F.cos(phase) - F.col("im") * F.sin(phase)), "zi": w * (F.col("re") * F.sin(phase) + F.col("im") * F.cos(phase))})
    df = df.withColumns({"fr": F.floor("pr"), "fc": F.floor("pc")})
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    df = df.withColumn("o", F.explode(corners))
    part = lambda p, f, o: F.when(F.col(o) == 1, F.col(p) - F.col(f)).otherwise(1.0 - (F.col(p) - F.col(f)))
    weight = part("pr", "fr", "o.a") * part("pc", "fc", "o.b")
    cell = lambda f, o, n: F.pmod(F.col(f) + F.col(o), F.lit(n)).cast("int")
    out = df.groupBy(*keys, cell("fr", "o.a", rows).alias("i0"), cell("fc", "o.b", cols).alias("i1")).agg(F.sum(weight * F.col("zr")).alias("re"), F.sum(weight * F.col("zi")).alias("im"))
    return Grid(out, (rows, cols), tuple(keys), True)


def radial_linear_gridding2_adjoint(samples: DataFrame, keys: tuple[str, ...], rows: int, cols: int) -> Grid:
    """Ramp-weighted gridding and an inverse transform that isn't divided by the number of points."""
    weighted = samples.withColumn("w", radial_analytic_ramp_dcf2(F.col("k_row"), F.col("k_col")))
    return transform(linear_gridding(weighted, keys, rows, cols).filled((rows, cols)), None, True, "none")


TRAJECTORY_UNITS = ("cycles_per_fov", "radians_per_pixel", "matrix_index")


def normalized_coordinate(k: Column, unit: str, n: int) -> Column:
    """A coordinate in radians a pixel; one that isn't finite or beyond the unit's range is an error."""
    factor, most = {"cycles_per_fov": (2 * math.pi, 0.5), "radians_per_pixel": (1.0, math.pi), "matrix_index": (2 * math.pi / n, n / 2)}[unit]
    bad = F.isnan(k) | (F.abs(k) > most)
    return F.when(bad, F.raise_error(F.lit(f"a trajectory coordinate is outside {unit}")).cast("double")).otherwise(k * F.lit(factor))


def normalized_trajectory(df: DataFrame, unit: str, rows: int, cols: int) -> DataFrame:
    """Raw (kx, ky) as (k_row, k_col) in radians a pixel: ky along rows, kx along columns."""
    return df.withColumns({"k_row": normalized_coordinate(F.col("ky"), unit, rows), "k_col": normalized_coordinate(F.col("kx"), unit, cols)})


