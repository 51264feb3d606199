"""Images (rank-2 grids): neighbourhood filters, morphology, resampling, thresholds, components.

A neighbourhood operator spreads each pixel over the offsets at which others see it and aggregates by pixel; at the border
the pixel positions asked for are mapped by the border rule, so the result is the one of a padded image.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import elementwise as el
from tessera.grid import Grid, ShapeError, constants
from tessera.operators import arrays, stats

BORDERS = ("replicate", "reflect", "reflect101", "constant")


def border_index(i: Column, n: int, mode: str) -> Column:
    """The pixel that position i (it may be outside) reads; null for a constant border outside."""
    inside = (i >= 0) & (i < n)
    if mode == "replicate":
        return F.greatest(F.least(i, F.lit(n - 1)), F.lit(0))
    if mode == "constant":
        return F.when(inside, i)
    if n == 1:
        return F.lit(0)
    if mode == "reflect":
        p = F.pmod(i, F.lit(2 * n))
        return F.when(p < n, p).otherwise(F.lit(2 * n - 1) - p)
    p = F.pmod(i, F.lit(2 * n - 2))
    return F.when(p < n, p).otherwise(F.lit(2 * n - 2) - p)


def _offsets(spark, weights: list[tuple[int, int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(w)).alias("w")) for a, b, w in weights])


def neighbours(g: Grid, weights: list[tuple[int, int, float]], border: str = "replicate") -> DataFrame:
    """keys, i0, i1, w, v for each pixel and offset (dr, dc, w): the value at (i0 + dr, i1 + dc) under the border rule, null
    outside for a constant border. An equi-join on the pixel read, on the frame's keys and place."""
    rows, cols = g.shape
    asked = g.df.select(*g.keys, "i0", "i1", F.explode(_offsets(g.df.sparkSession, weights)).alias("o"))
    asked = asked.select(*g.keys, "i0", "i1", "o.w", border_index(F.col("i0") + F.col("o.dr"), rows, border).cast("int").alias("r"), border_index(F.col("i1") + F.col("o.dc"), cols, border).cast("int").alias("c"))
    source = g.df.select(*g.keys, F.col("i0").alias("r"), F.col("i1").alias("c"), *g.values)
    return asked.join(source, [*g.keys, "r", "c"], "left")


def _gathered(g: Grid, weights, border: str, agg: Column) -> Grid:
    df = neighbours(g, weights, border).groupBy(*g.keys, "i0", "i1").agg(agg.alias("v"))
    return replace(g, df=df, is_complex=False)


def kernel_weights(kernel, anchor: tuple[int, int] | None = None) -> list[tuple[int, int, float]]:
    k = np.asarray(kernel, float)
    ar, ac = anchor if anchor is not None else (k.shape[0] // 2, k.shape[1] // 2)
    return [(i - ar, j - ac, float(k[i, j])) for i in range(k.shape[0]) for j in range(k.shape[1])]


def filter2d(g: Grid, kernel, border: str = "replicate", anchor: tuple[int, int] | None = None, constant: float = 0.0) -> Grid:
    """Correlation: the kernel isn't flipped; its anchor is the middle (k // 2) unless given."""
    return _gathered(g, kernel_weights(kernel, anchor), border, F.sum(F.col("w") * F.coalesce("v", F.lit(float(constant)))))


def filter2d_region(g: Grid, kernel, start: tuple[int, int], size: tuple[int, int], border: str = "replicate") -> Grid:
    return arrays.crop(filter2d(g, kernel, border), start, size)


#: Elements of a volume up to which frames are filtered whole, one a row.
PACKED = 1 << 20


def filter3d_replicate(g: Grid, kernel) -> Grid:
    """A kernel over three axes with a replicated border; nulls count for nothing. Frames that come packed are filtered in
    stacks, without a shuffle; of others, and large ones, each element is spread over those whose windows it lies in."""
    k = np.asarray(kernel, float)
    if g.rank != 3 or k.ndim != 3 or not k.size:
        raise ShapeError(f"a kernel of shape {k.shape} over arrays of shape {g.shape}")
    if g.packed is None or g.size > PACKED:
        return _filter3d_spread(g, k)
    return g.kernel(lambda x: _filter3d_stack(x, k), g.shape, g.is_complex, masked=True)


def _filter3d_stack(x: np.ma.MaskedArray, k: np.ndarray) -> np.ma.MaskedArray:
    null = np.ma.getmaskarray(x)
    around = [(0, 0), *[(n // 2, n - 1 - n // 2) for n in k.shape]]
    data = np.pad(np.where(null, 0.0, np.ma.getdata(x)), around, "edge")
    seen = np.pad(~null, around, "edge") if null.any() else None
    total, found = np.zeros(x.shape, data.dtype), np.full(x.shape, seen is None)
    for at in np.ndindex(k.shape):
        window = (slice(None), *[slice(p, p + n) for p, n in zip(at, x.shape[1:], strict=True)])
        total += k[at] * data[window]
        if seen is not None:
            found |= seen[window]
    return np.ma.MaskedArray(total, ~found)


def _filter3d_spread(g: Grid, k: np.ndarray) -> Grid:
    """Spark guesses the long form from the size of the arrays' file, and so would broadcast one side of a join on its
    elements, however many they are: there is none here. An element that is missing or there twice is an error."""
    offs = F.array(*[F.struct(*[F.lit(int(p - n // 2)).alias(f"d{d}") for d, (p, n) in enumerate(zip(at, k.shape, strict=True))], F.lit(float(k[at])).alias("w")) for at in np.ndindex(k.shape)])
    df = g.df.select(*g.keys, *g.index, *g.values, F.explode(offs).alias("o"))
    for d, (c, n) in enumerate(zip(g.index, g.shape, strict=True)):
        # the places along an axis that read c by this offset: one, at the border a run, or none
        at = F.col(c) - F.col(f"o.d{d}")
        df = df.withColumn(f"a{d}", F.when(F.col(c) == 0, F.lit(0)).otherwise(F.greatest(at, F.lit(0)))).withColumn(f"b{d}", F.when(F.col(c) == n - 1, F.lit(n - 1)).otherwise(F.least(at, F.lit(n - 1))))
    df = df.where((F.col("a0") <= F.col("b0")) & (F.col("a1") <= F.col("b1")) & (F.col("a2") <= F.col("b2")))
    for d, c in enumerate(g.index):
        df = df.withColumn(c, F.explode(F.sequence(f"a{d}", f"b{d}")))
    df = df.groupBy(*g.keys, *g.index).agg(F.count(F.lit(1)).alias("taps"), *[F.sum(F.col("o.w") * F.col(c)).alias(c) for c in g.values])
    fail = F.raise_error(F.lit(f"an array does not have each of the {g.size} elements of its shape once")).cast("double")
    return replace(g, df=df.select(*g.keys, *g.index, *[F.when(F.col("taps") == k.size, F.col(c)).otherwise(fail).alias(c) for c in g.values]))


def box_filter(g: Grid, kr: int, kc: int, border: str = "replicate") -> Grid:
    """Window sum over kr kc, also at a constant border; an even window spans -k/2 .. k/2 - 1."""
    return filter2d(g, np.full((kr, kc), 1.0 / (kr * kc)), border)


def gaussian_kernel(k: int = 5, sigma: float = 1.0) -> np.ndarray:
    x = np.arange(k) - (k - 1) / 2
    w = np.exp(-x * x / (2 * sigma * sigma))
    return w / w.sum()


def gaussian_blur(g: Grid, k: int = 5, sigma: float = 1.0, border: str = "replicate") -> Grid:
    w = gaussian_kernel(k, sigma)
    return filter2d(filter2d(g, w[None, :], border), w[:, None], border)


def bilateral_filter(g: Grid, diameter: int, sigma_color: float, sigma_space: float, border: str = "replicate") -> Grid:
    """Weights by distance within a circle, and by the difference to the middle pixel."""
    r = diameter // 2
    w = [(a, b, math.exp(-(a * a + b * b) / (2 * sigma_space**2))) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    mid = g.df.select(*g.keys, "i0", "i1", F.col("v").alias("mid"))
    n = neighbours(g, w, border).withColumn("v", F.coalesce("v", F.lit(0.0))).join(mid, [*g.keys, "i0", "i1"])
    k = F.col("w") * F.exp(-(F.col("v") - F.col("mid")) * (F.col("v") - F.col("mid")) / F.lit(2 * sigma_color**2))
    return replace(g, df=n.groupBy(*g.keys, "i0", "i1").agg((F.sum(k * F.col("v")) / F.sum(k)).alias("v")))


def box(rows: int, cols: int) -> list[tuple[int, int, float]]:
    return [(a - rows // 2, b - cols // 2, 1.0) for a in range(rows) for b in range(cols)]


def ellipse(rows: int, cols: int) -> list[tuple[int, int, float]]:
    ry, rx = rows // 2, cols // 2
    return [(a, b, 1.0) for a in range(-ry, ry + 1) for b in range(-rx, rx + 1) if (a / max(ry, 1)) ** 2 + (b / max(rx, 1)) ** 2 <= 1]


def disk_structuring_element(radius: int) -> list[tuple[int, int, float]]:
    return [(a, b, 1.0) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


CROSS = [(0, 0, 1.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)]


def median_filter(g: Grid, k: int, border: str = "replicate") -> Grid:
    return _gathered(g, box(k, k), border, F.median(F.coalesce("v", F.lit(0.0))))


def _interior(g: Grid, value: Column, outside: float = 0.0) -> Grid:
    rows, cols = g.shape
    inner = F.col("i0").between(1, rows - 2) & F.col("i1").between(1, cols - 2)
    return replace(g, df=g.df.withColumn("v", F.when(inner, value).otherwise(F.lit(outside))))


def median3x3_interior_zero(g: Grid) -> Grid:
    return _interior(median_filter(g, 3), F.col("v"))


def phase_quality_map3x3(g: Grid, limit: float = 0.070) -> Grid:
    """0 where the mean resultant of the phases around (over 81) is under the limit, else 1; 0 at the border."""
    df = neighbours(g, box(3, 3)).groupBy(*g.keys, "i0", "i1").agg((F.hypot(F.sum(F.cos("v")), F.sum(F.sin("v"))) / 81.0).alias("v"))
    return _interior(replace(g, df=df), F.when(F.col("v") < limit, 0.0).otherwise(1.0))


SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]


def sobel_x(g: Grid, border: str = "replicate") -> Grid:
    return filter2d(g, SOBEL_X, border)


def sobel_y(g: Grid, border: str = "replicate") -> Grid:
    return filter2d(g, np.array(SOBEL_X).T, border)


def gradient_magnitude(g: Grid, border: str = "replicate") -> Grid:
    """Both gradients from one look at the neighbours."""
    x = {(a, b): w for a, b, w in kernel_weights(SOBEL_X)}
    y = {(a, b): w for a, b, w in kernel_weights(np.array(SOBEL_X).T)}
    code = [(a, b, x[a, b] * 16 + y[a, b]) for a, b in x]
    wy = F.pmod(F.col("w") + 8, F.lit(16.0)) - 8
    wx = (F.col("w") - wy) / 16
    v = F.coalesce("v", F.lit(0.0))
    return _gathered(g, code, border, F.hypot(F.sum(wx * v), F.sum(wy * v)))


def laplacian(g: Grid, border: str = "replicate") -> Grid:
    return filter2d(g, LAPLACIAN, border)


def unsharp_mask(g: Grid, amount: float = 1.0, k: int = 5, sigma: float = 1.0) -> Grid:
    return g.zip(gaussian_blur(g, k, sigma), lambda v, b: v + (v - b) * amount)


# ---------------------------------------------------------------- morphology
def dilate(g: Grid, element: list[tuple[int, int, float]], border: str = "replicate") -> Grid:
    return _gathered(g, element, border, F.max(F.coalesce("v", F.lit(0.0))))


def erode(g: Grid, element: list[tuple[int, int, float]], border: str = "replicate") -> Grid:
    return _gathered(g, element, border, F.min(F.coalesce("v", F.lit(0.0))))


def morph_open(g: Grid, element, border: str = "replicate") -> Grid:
    return dilate(erode(g, element, border), element, border)


def morph_close(g: Grid, element, border: str = "replicate") -> Grid:
    return erode(dilate(g, element, border), element, border)


def dilate_mask(g: Grid, element) -> Grid:
    """Non-zero where any pixel under the element is; outside counts as empty."""
    return _gathered(g, element, "constant", F.max(F.when(F.coalesce("v", F.lit(0.0)) != 0, 1.0).otherwise(0.0)))


def erode_mask(g: Grid, element) -> Grid:
    return _gathered(g, element, "constant", F.min(F.when(F.coalesce("v", F.lit(0.0)) != 0, 1.0).otherwise(0.0)))


def _cross(g: Grid, own: Callable[[Column], Column], near: Callable[[Column], Column], value: float) -> Grid:
    """Inner pixels that are `own` and have a 4-neighbour that is `near` get the value; all others, the border's too, stay."""
    rows, cols = g.shape
    n = neighbours(g, CROSS, "constant")
    middle = (F.col("r") == F.col("i0")) & (F.col("c") == F.col("i1"))
    df = n.groupBy(*g.keys, "i0", "i1").agg(F.bool_or(F.coalesce(~middle & near(F.col("v")), F.lit(False))).alias("hit"), F.max(F.when(middle, F.col("v"))).alias("own"))
    inner = F.col("i0").between(1, rows - 2) & F.col("i1").between(1, cols - 2)
    return replace(g, df=df.select(*g.keys, "i0", "i1", F.when(inner & own(F.col("own")) & F.col("hit"), F.lit(float(value))).otherwise(F.col("own")).alias("v")))


def dilate_cross_value(g: Grid, value: float) -> Grid:
    """Inner pixels with a 4-neighbour of the value get it."""
    return _cross(g, lambda v: v != value, lambda v: v == value, value)


def erode_cross_value(g: Grid, value: float, background: float = 0.0) -> Grid:
    """Inner pixels of the value with a 4-neighbour that hasn't it become background."""
    return _cross(g, lambda v: v == value, lambda v: v != value, background)


def dilate_threshold_cross(g: Grid, center: float, neighbour: float, value: float) -> Grid:
    """Inner pixels under `center` with a 4-neighbour over `neighbour` get the value."""
    return _cross(g, lambda v: v < center, lambda v: v > neighbour, value)


def erode_threshold_cross(g: Grid, center: float, neighbour: float, value: float) -> Grid:
    """Inner pixels over `center` with a 4-neighbour under `neighbour` get the value."""
    return _cross(g, lambda v: v > center, lambda v: v < neighbour, value)


def distance_transform_l2(g: Grid) -> Grid:
    """Distance of each pixel to the nearest zero one, infinite without any; exact, by rows then columns on one image."""

    def f(x: np.ndarray) -> np.ndarray:
        rows, cols = x.shape
        d = np.where(x == 0, 0.0, np.inf)
        for j in range(1, cols):
            d[:, j] = np.minimum(d[:, j], d[:, j - 1] + 1)
        for j in range(cols - 2, -1, -1):
            d[:, j] = np.minimum(d[:, j], d[:, j + 1] + 1)
        gap = (np.arange(rows)[:, None] - np.arange(rows)[None, :]) ** 2.0
        return np.sqrt((d[None, :, :] ** 2 + gap[:, :, None]).min(1))

    return g.kernel(f, g.shape)


def labelled(x: np.ndarray, eight: bool = False) -> np.ndarray:
    """Labels from 1 of the connected non-zero pixels, in the order of their first pixels; 0 elsewhere."""
    rows, cols = x.shape
    out = np.zeros(x.shape, np.int64)
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if eight else [])
    label = 0
    for i, j in np.argwhere(x != 0):
        if out[i, j]:
            continue
        label += 1
        todo = [(int(i), int(j))]
        out[i, j] = label
        while todo:
            a, b = todo.pop()
            for p, q in ((a + s, b + t) for s, t in steps):
                if 0 <= p < rows and 0 <= q < cols and x[p, q] != 0 and not out[p, q]:
                    out[p, q] = label
                    todo.append((p, q))
    return out


def connected_components(g: Grid, eight: bool = False) -> Grid:
    return g.kernel(lambda x: labelled(x, eight), g.shape)


def component_stats(labels: Grid) -> DataFrame:
    """keys, label, area, box and centroid of each component."""
    df = labels.df.where("v > 0")
    return df.groupBy(*labels.keys, F.col("v").cast("int").alias("label")).agg(F.count("*").alias("area"), F.min("i0").alias("top"), F.max("i0").alias("bottom"), F.min("i1").alias("left"), F.max("i1").alias("right"), F.avg("i0").alias("row"), F.avg("i1").alias("col"))


def keep_largest_component(g: Grid, eight: bool = False) -> Grid:
    """1 on the largest component, the first of equals; 0 elsewhere."""

    def f(x: np.ndarray) -> np.ndarray:
        lab = labelled(x, eight)
        n = np.bincount(lab.ravel())[1:]
        return (lab == n.argmax() + 1).astype(float) if len(n) else np.zeros(x.shape)

    return g.kernel(f, g.shape)


def region_grow(g: Grid, seed: tuple[int, int], low: float, high: float, eight: bool = False) -> Grid:
    """1 on the pixels in [low, high] connected to the seed."""

    def f(x: np.ndarray) -> np.ndarray:
        lab = labelled((x >= low) & (x <= high), eight)
        return (lab == lab[seed]).astype(float) if lab[seed] else np.zeros(x.shape)

    return g.kernel(f, g.shape)


def fill_holes(g: Grid, value: float = 1.0) -> Grid:
    """value where the input is not 0, or where no 4-path of zeros leads to an edge; else 0."""

    def f(x: np.ndarray) -> np.ndarray:
        lab = labelled(x == 0)
        edge = np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
        return np.where((x == 0) & np.isin(lab, edge[edge > 0]), 0.0, value)

    return g.kernel(f, g.shape)


# ---------------------------------------------------------------- geometry
def pad(g: Grid, top: int, bottom: int, left: int, right: int, border: str = "constant", value: float = 0.0) -> Grid:
    rows, cols = g.shape
    shape = (rows + top + bottom, cols + left + right)
    every = g.frames().withColumn("i0", F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1)))).withColumn("i1", F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))))
    every = every.withColumns({"r": border_index(F.col("i0") - top, rows, border).cast("int"), "c": border_index(F.col("i1") - left, cols, border).cast("int")})
    source = g.df.select(*g.keys, F.col("i0").alias("r"), F.col("i1").alias("c"), *g.values)
    df = every.join(source, [*g.keys, "r", "c"], "left")
    return replace(g, df=df.select(*g.keys, "i0", "i1", *[F.coalesce(c, F.lit(float(value))).alias(c) for c in g.values]), shape=shape)


def center_crop(g: Grid, rows: int, cols: int) -> Grid:
    return arrays.crop(g, ((g.shape[0] - rows) // 2, (g.shape[1] - cols) // 2), (rows, cols))


def center_pad_or_crop(g: Grid, rows: int, cols: int) -> Grid:
    return arrays.copy_centered(g, (rows, cols), upper=False)


def copy_roi(target: Grid, patch: Grid, row: int, col: int) -> Grid:
    """patch put over target at (row, col)."""
    moved = patch.df.select(*patch.keys, (F.col("i0") + row).alias("i0"), (F.col("i1") + col).alias("i1"), *[F.col(c).alias(f"p_{c}") for c in patch.values])
    df = target.df.join(moved, [*target.keys, "i0", "i1"], "left")
    return replace(target, df=df.select(*target.keys, "i0", "i1", *[F.coalesce(f"p_{c}", c).alias(c) for c in target.values]))


def cubic_weight(x: float, a: float = -0.75) -> float:
    x = abs(x)
    if x <= 1:
        return (a + 2) * x**3 - (a + 3) * x**2 + 1
    return a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a if x < 2 else 0.0


def mitchell_weight(x: float) -> float:
    x = abs(x)
    b = c = 1 / 3
    if x < 1:
        return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
    return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6 if x < 2 else 0.0


def lanczos_weight(x: float, a: int) -> float:
    return float(np.sinc(x) * np.sinc(x / a)) if abs(x) < a else 0.0


SUPPORT: dict[str, tuple[int, Callable[[float], float]]] = {"linear": (1, lambda x: max(0.0, 1 - abs(x))), "cubic": (2, cubic_weight), "mitchell": (2, mitchell_weight), "lanczos3": (3, lambda x: lanczos_weight(x, 3)), "lanczos4": (4, lambda x: lanczos_weight(x, 4))}


def taps(n: int, m: int, kind: str) -> list[tuple[int, int, float]]:
    """(output, input, weight) of an axis of n points resampled to m, ends on ends, borders replicated."""
    out = []
    for i in range(m):
        x = i * (n - 1) / (m - 1) if m > 1 else 0.0
        if kind == "nearest":
            out.append((i, min(int(math.floor(x + 0.5)), n - 1), 1.0))
            continue
        if kind == "area":
            a, b = i * n / m, (i + 1) * n / m
            w = {p: min(b, p + 1) - max(a, p) for p in range(int(a), min(n, math.ceil(b)))}
        else:
            reach, f = SUPPORT[kind]
            base, w = math.floor(x), {}
            for p in range(base - reach + 1, base + reach + 1):
                q = min(max(p, 0), n - 1)
                w[q] = w.get(q, 0.0) + f(x - p)
        total = sum(w.values())
        out += [(i, p, v / total) for p, v in w.items() if v]
    return out


def resample_axis(g: Grid, dim: int, m: int, kind: str = "linear") -> Grid:
    """A sparse matrix along one axis: each element goes to the outputs that its taps name."""
    c = g.index[dim]
    by_input: dict[int, list] = {}
    for o, i, w in taps(g.shape[dim], m, kind):
        by_input.setdefault(i, []).append((o, w))
    spark = g.df.sparkSession
    # a table of the axis's taps: as many rows as the output axis is long times the reach
    table = spark.createDataFrame([(i, o, float(w)) for i, v in by_input.items() for o, w in v], "src int, dst int, w double")
    rest = [x for x in g.index if x != c]
    df = g.df.join(table, F.col(c) == F.col("src")).groupBy(*g.keys, *rest, F.col("dst").alias(c)).agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in g.values])
    return replace(g, df=df.select(*g.keys, *g.index, *g.values), shape=tuple(m if d == dim else n for d, n in enumerate(g.shape)))


def resize(g: Grid, rows: int, cols: int, kind: str = "linear") -> Grid:
    return resample_axis(resample_axis(g, 0, rows, kind), 1, cols, kind)


def resize_volume_cubic(g: Grid, a: int, b: int, c: int) -> Grid:
    return resample_axis(resize(g, a, b, "cubic"), 2, c, "cubic")


def bspline_weight(x: float) -> float:
    """The cubic B-spline, which smooths as it interpolates."""
    x = abs(x)
    return (4 - 6 * x * x + 3 * x**3) / 6 if x < 1 else (2 - x) ** 3 / 6 if x < 2 else 0.0


def rotate_cubic_bspline_smooth(g: Grid, radians: float) -> Grid:
    return rotate_cubic(g, radians, bspline_weight)


def rotate_cubic(g: Grid, radians: float, weight: Callable[[float], float] = cubic_weight) -> Grid:
    """About the middle, by cubic interpolation of the rotated positions; outside is 0."""
    rows, cols = g.shape

    def f(x: np.ndarray) -> np.ndarray:
        cy, cx = (rows - 1) / 2, (cols - 1) / 2
        yy, xx = np.mgrid[0:rows, 0:cols]
        sy = math.cos(radians) * (yy - cy) + math.sin(radians) * (xx - cx) + cy
        sx = -math.sin(radians) * (yy - cy) + math.cos(radians) * (xx - cx) + cx
        by, bx = np.floor(sy).astype(int), np.floor(sx).astype(int)
        out = np.zeros(x.shape)
        w = np.vectorize(weight)
        for p in range(-1, 3):
            for q in range(-1, 3):
                ys, xs = by + p, bx + q
                ok = (ys >= 0) & (ys < rows) & (xs >= 0) & (xs < cols)
                out += np.where(ok, x[np.clip(ys, 0, rows - 1), np.clip(xs, 0, cols - 1)], 0.0) * w(sy - ys) * w(sx - xs)
        return out

    return g.kernel(f, g.shape)


# ---------------------------------------------------------------- thresholds and intensity
def threshold(g: Grid, t: float, high: float = 1.0, low: float = 0.0) -> Grid:
    return g.map(lambda v: el.threshold(v, t, high, low))


def normalize_minmax(g: Grid) -> Grid:
    """(v - min) / (max - min) of each image; a constant one gives 0."""
    ends = g.df.groupBy(*g.keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    df = g.df.join(ends, list(g.keys)) if g.keys else g.df.crossJoin(F.broadcast(ends))
    span = F.col("hi") - F.col("lo")
    return replace(g, df=df.select(*g.keys, *g.index, F.when(span > 0, (F.col("v") - F.col("lo")) / F.when(span > 0, span)).otherwise(0.0).alias("v")))


def otsu_mask(g: Grid, high: float = 1.0, low: float = 0.0) -> Grid:
    """high where v is above the image's Otsu threshold, not at it."""
    t = stats.otsu_threshold(g)
    df = g.df.join(t, list(g.keys)) if g.keys else g.df.crossJoin(F.broadcast(t))
    return replace(g, df=df.select(*g.keys, *g.index, F.when(F.col("v") > F.col("threshold"), F.lit(high)).otherwise(F.lit(low)).alias("v")))


def scaled_to_levels(g: Grid, levels: int = 256) -> Grid:
    """Each image so that its largest value is levels - 1, limited to [0, levels - 1]; 0 where none is above 0."""
    top = g.df.groupBy(*g.keys).agg(F.max("v").alias("top"))
    df = g.df.join(top, list(g.keys)) if g.keys else g.df.crossJoin(F.broadcast(top))
    last = float(levels - 1)
    v = F.when(F.col("top") > 0, F.greatest(F.least(F.col("v") * (F.lit(last) / F.when(F.col("top") > 0, F.col("top"))), F.lit(last)), F.lit(0.0))).otherwise(0.0)
    return replace(g, df=df.select(*g.keys, *g.index, v.alias("v")))


def multi_otsu_thresholds_scaled(g: Grid, classes: int = 4, levels: int = 256) -> Grid:
    """0 and then classes - 1 grey levels of each image scaled to levels: of all ways to part the levels from 1 on, the
    first with the largest sum over classes of (sum of level x share)^2 / share, where a class of one level counts 0. Dynamic
    programming from the last class back."""
    if not 2 <= classes <= 5 or levels < 2:
        raise ValueError("multi_otsu_thresholds_scaled: 2 to 5 classes and at least 2 levels")

    def f(x: np.ndarray) -> np.ndarray:
        out, last = np.zeros(classes), levels - 1
        h = np.bincount(np.minimum((x.ravel() + 0.5).astype(int), last), minlength=levels) / x.size
        h[0] = 0.0
        p, s = np.concatenate([[0.0], np.cumsum(h)]), np.concatenate([[0.0], np.cumsum(h * np.arange(levels))])
        w, m = p[None, 1:] - p[:-1, None], s[None, 1:] - s[:-1, None]  # of levels begin .. end
        score = np.where(w > 1e-15, m * m / np.where(w > 1e-15, w, 1.0), 0.0)
        score[np.tril_indices(levels)] = 0.0
        rest, choice = score[:, last].copy(), []  # the best from level b on with one class
        for k in range(classes - 1, 0, -1):
            most = levels - classes + k - 1  # the largest place of the k-th threshold
            t = score[:, : most + 1] + rest[1 : most + 2][None, :]
            t[np.arange(levels)[:, None] > np.arange(most + 1)[None, :]] = -np.inf
            choice.insert(0, t.argmax(1))
            rest = t.max(1)
        if rest[1] > 0:
            at = 1
            for k, c in enumerate(choice, 1):
                out[k] = c[at]
                at = int(c[at]) + 1
        return out

    return scaled_to_levels(g, levels).kernel(f, (classes,))


def denoise_magnitude(g: Grid, h: float = 0.1, patch: int = 3, search: int = 7) -> Grid:
    """Non-local means: each pixel is the mean of pixels around, weighted by the likeness of their patches."""
    r, s = patch // 2, search // 2

    def f(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, r + s, mode="edge")
        rows, cols = x.shape
        total, weight = np.zeros(x.shape), np.zeros(x.shape)
        mid = np.lib.stride_tricks.sliding_window_view(p, (patch, patch))
        base = mid[s : s + rows, s : s + cols]
        for a in range(-s, s + 1):
            for b in range(-s, s + 1):
                d = ((mid[s + a : s + a + rows, s + b : s + b + cols] - base) ** 2).mean((2, 3))
                w = np.exp(-d / (h * h))
                total += w * p[r + s + a : r + s + a + rows, r + s + b : r + s + b + cols]
                weight += w
        return total / weight

    return g.kernel(f, g.shape)


def calculate_volume_foreground_mask(g: Grid) -> Grid:
    """1 on the largest part of a volume over its Otsu threshold, 6-connected, with its holes filled."""
    t = stats.otsu_threshold(g)
    df = g.df.join(t, list(g.keys)) if g.keys else g.df.crossJoin(F.broadcast(t))
    above = replace(g, df=df.select(*g.keys, *g.index, F.when(F.col("v") > F.col("threshold"), 1.0).otherwise(0.0).alias("v")))

    def parts(x: np.ndarray) -> np.ndarray:
        lab, label = np.zeros(x.shape, int), 0
        for start in np.argwhere(x):
            if lab[tuple(start)]:
                continue
            label += 1
            todo = [tuple(int(i) for i in start)]
            lab[todo[0]] = label
            while todo:
                at = todo.pop()
                for d in range(3):
                    for step in (-1, 1):
                        q = list(at)
                        q[d] += step
                        if 0 <= q[d] < x.shape[d] and x[tuple(q)] and not lab[tuple(q)]:
                            lab[tuple(q)] = label
                            todo.append(tuple(q))
        return lab

    def f(x: np.ndarray) -> np.ndarray:
        lab = parts(x > 0)
        n = np.bincount(lab.ravel())[1:]
        if not len(n):
            return np.zeros(x.shape)
        body = lab == n.argmax() + 1
        out = parts(~body)
        edge = np.unique(np.concatenate([np.take(out, [0, -1], d).ravel() for d in range(3)]))
        return (body | ~np.isin(out, edge[edge > 0])).astype(float)

    return above.kernel(f, g.shape)


def align_ecc_euclidean(reference: Grid, moving: Grid, iterations: int = 20, epsilon: float = 1e-10) -> Grid:
    """angle, row and column shift that lay `moving` on `reference`: Gauss-Newton steps that raise the correlation of the
    mean-free images."""
    if reference.shape != moving.shape or reference.keys != moving.keys:
        raise ShapeError("images of equal shape and keys")
    rows, cols = reference.shape
    both = reference.df.withColumn("i2", F.lit(0)).unionByName(moving.df.withColumn("i2", F.lit(1)))

    def sample(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        y, z = np.clip(y, 0, rows - 1), np.clip(z, 0, cols - 1)
        a, b = np.minimum(y.astype(int), rows - 2), np.minimum(z.astype(int), cols - 2)
        u, v = y - a, z - b
        return (1 - u) * ((1 - v) * x[a, b] + v * x[a, b + 1]) + u * ((1 - v) * x[a + 1, b] + v * x[a + 1, b + 1])

    def f(x: np.ndarray) -> np.ndarray:
        ref, mov = x[..., 0], x[..., 1]
        gy, gx = np.gradient(mov)
        yy, xx = np.mgrid[0:rows, 0:cols]
        cy, cx = yy - (rows - 1) / 2, xx - (cols - 1) / 2
        p, before = np.zeros(3), -2.0
        r = ref - ref.mean()
        for _ in range(iterations):
            c, s = math.cos(p[0]), math.sin(p[0])
            py, px = c * cy + s * cx + (rows - 1) / 2 + p[1], -s * cy + c * cx + (cols - 1) / 2 + p[2]
            w = sample(mov, py, px)
            w = w - w.mean()
            norm = np.linalg.norm(r) * np.linalg.norm(w)
            rho = float((r * w).sum() / norm) if norm else 0.0
            if abs(rho - before) < epsilon:
                break
            before = rho
            iy, ix = sample(gy, py, px), sample(gx, py, px)
            j = np.stack([(iy * (-s * cy + c * cx) + ix * (-c * cy - s * cx)).ravel(), iy.ravel(), ix.ravel()], 1)
            j = j - j.mean(0)
            scale = np.linalg.norm(w) / (np.linalg.norm(r) or 1.0)
            p = p + np.linalg.lstsq(j, (r * scale - w).ravel(), rcond=None)[0]
        return p

    return Grid(both, (rows, cols, 2), reference.keys).kernel(f, (3,))


def bm3d_denoise_magnitude(g: Grid, sigma: float, block: int = 4, search: int = 9, most: int = 16) -> Grid:
    """Block matching: like blocks around a block are stacked, transformed together, coefficients under 2.7 sigma dropped, and
    all estimates of a pixel averaged by how sparse their stacks were (one stage)."""

    def basis(n: int) -> np.ndarray:
        k = np.cos(np.pi * np.outer(np.arange(n), np.arange(n) + 0.5) / n) * np.sqrt(2 / n)
        k[0] /= np.sqrt(2)
        return k

    d = basis(block)

    def f(x: np.ndarray) -> np.ndarray:
        rows, cols = x.shape
        if min(rows, cols) < block:
            return x
        views = np.lib.stride_tricks.sliding_window_view(x, (block, block))
        total, weight = np.zeros(x.shape), np.zeros(x.shape)
        for i in sorted({*range(0, rows - block + 1, 2), rows - block}):
            for j in sorted({*range(0, cols - block + 1, 2), cols - block}):
                a, b = max(0, i - search // 2), max(0, j - search // 2)
                near = views[a : i + search // 2 + 1, b : j + search // 2 + 1]
                gap = ((near - views[i, j]) ** 2).mean((2, 3))
                at = np.argsort(gap, axis=None, kind="stable")[:most]
                p, q = np.unravel_index(at, gap.shape)
                t = basis(len(at))
                z = np.einsum("st,tab->sab", t, np.einsum("ua,tab,vb->tuv", d, near[p, q], d))
                keep = np.abs(z) >= 2.7 * sigma
                keep[0, 0, 0] = True
                w = 1.0 / keep.sum()
                y = np.einsum("ua,tuv,vb->tab", d, np.einsum("st,sab->tab", t, z * keep), d)
                for k in range(len(at)):
                    total[a + p[k] : a + p[k] + block, b + q[k] : b + q[k] + block] += w * y[k]
                    weight[a + p[k] : a + p[k] + block, b + q[k] : b + q[k] + block] += w
        return total / weight

    return g.kernel(f, g.shape)


def grid_of(spark, rows: int, cols: int, f: Callable[[Column, Column], Column]) -> Grid:
    return constants(spark, (rows, cols), lambda lin, i, j: f(i, j))


