"""Reshaping, selecting, gathering and building arrays (grids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cplx
from tessera.grid import Grid, ShapeError, constants, index_names


# ---------------------------------------------------------------- building
def full(spark, shape, value) -> Grid:
    return constants(spark, shape, lambda lin, *i: F.lit(float(value)))


def zeros(spark, shape) -> Grid:
    return full(spark, shape, 0.0)


def ones(spark, shape) -> Grid:
    return full(spark, shape, 1.0)


def identity(spark, rows, cols) -> Grid:
    return constants(spark, (rows, cols), lambda lin, i, j: F.when(i == j, 1.0).otherwise(0.0))


eye = identity


def linspace(spark, shape, start, stop) -> Grid:
    """start to stop over all elements in row-major order; one element is start."""
    n = 1
    for d in shape:
        n *= d
    return constants(spark, shape, lambda lin, *i: F.lit(float(start)) + lin * F.lit((stop - start) / (n - 1) if n > 1 else 0.0))


def uniform_random(spark, shape, lower, upper, seed=0) -> Grid:
    """Uniform in [lower, upper), a function of the seed and the position alone, so reruns and other partitions agree."""
    u = lambda lin: F.pmod(F.xxhash64(lin, F.lit(seed)), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    return constants(spark, shape, lambda lin, *i: F.lit(float(lower)) + u(lin) * F.lit(float(upper - lower)))


def fill(g: Grid, value) -> Grid:
    return g.map(lambda *_: F.lit(float(value)))


def copy(g: Grid) -> Grid:
    return g


def set_identity(g: Grid) -> Grid:
    return g.map(lambda *_: F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0))


# ---------------------------------------------------------------- moving elements
def axes(g: Grid, *order: int) -> Grid:
    """Permuted axes."""
    return g.reindex(tuple(g.shape[d] for d in order), None, *[F.col(g.index[d]) for d in order])


def transpose(g: Grid) -> Grid:
    return axes(g, 1, 0)


def reverse(g: Grid, *dims: int) -> Grid:
    """Reversed along the axes given, along all if none are."""
    dims = dims or tuple(range(g.rank))
    return g.reindex(g.shape, None, *[F.lit(n - 1) - F.col(c) if d in dims else F.col(c) for d, (c, n) in enumerate(zip(g.index, g.shape, strict=True))])


def reverse_rows(g: Grid) -> Grid:
    return reverse(g, 0)


def reverse_cols(g: Grid) -> Grid:
    return reverse(g, 1)


rotate_180 = reverse


def transpose_rotated_180(g: Grid) -> Grid:
    return transpose(reverse(g, 0, 1))


def roll(g: Grid, *shifts: int) -> Grid:
    """Element x[i] moves to (i + shift) mod n."""
    return g.reindex(g.shape, None, *[F.pmod(F.col(c) + F.lit(s), F.lit(n)) for c, n, s in zip(g.index, g.shape, shifts, strict=True)])


def rotate_left(g: Grid, by: int) -> Grid:
    return roll(g, -by)


def fftshift(g: Grid) -> Grid:
    return roll(g, *[n // 2 for n in g.shape])


def ifftshift(g: Grid) -> Grid:
    return roll(g, *[-(n // 2) for n in g.shape])


def reshape(g: Grid, *shape: int) -> Grid:
    n = 1
    for d in shape:
        n *= d
    if n != g.size:
        raise ShapeError(f"{g.shape} has {g.size} elements, {shape} {n}")
    exprs, step, lin = [], n, g.linear()
    for d in shape:
        step //= d
        exprs.append(F.pmod(F.floor(lin / F.lit(step)), F.lit(d)))
    return g.reindex(shape, None, *exprs)


def ravel(g: Grid) -> Grid:
    return reshape(g, g.size)


def slice_axis(g: Grid, dim: int, start: int, stop: int, step: int = 1) -> Grid:
    """[start, stop) by step > 0, within bounds."""
    n = g.shape[dim]
    if step <= 0 or not 0 <= start <= stop <= n:
        raise ShapeError(f"slice [{start}, {stop}) by {step} of an axis of {n}")
    c = F.col(g.index[dim])
    shape = tuple(-(-(stop - start) // step) if d == dim else k for d, k in enumerate(g.shape))
    exprs = [F.floor((c - start) / F.lit(step)) if d == dim else F.col(x) for d, x in enumerate(g.index)]
    return g.reindex(shape, (c >= start) & (c < stop) & ((c - start) % step == 0), *exprs)


def select_index(g: Grid, dim: int, at: int) -> Grid:
    """One position of an axis, which goes."""
    keep = [d for d in range(g.rank) if d != dim]
    return g.reindex(tuple(g.shape[d] for d in keep), F.col(g.index[dim]) == at, *[F.col(g.index[d]) for d in keep])


def crop(g: Grid, starts: tuple[int, ...], sizes: tuple[int, ...]) -> Grid:
    where = F.lit(True)
    for c, n, a, s in zip(g.index, g.shape, starts, sizes, strict=True):
        if a < 0 or s < 0 or a + s > n:
            raise ShapeError(f"region [{a}, {a + s}) of an axis of {n}")
        where = where & (F.col(c) >= a) & (F.col(c) < a + s)
    return g.reindex(sizes, where, *[F.col(c) - a for c, a in zip(g.index, starts, strict=True)])


def copy_centered(g: Grid, shape: tuple[int, ...], background: float = 0.0, upper: bool = True) -> Grid:
    """The centred common part in a background of another shape: middles n // 2 on each other (upper), or half the difference
    of the sizes, rounded down, before it."""
    where, exprs = F.lit(True), []
    for c, n, m in zip(g.index, g.shape, shape, strict=True):
        big, small = max(n, m), min(n, m)
        off = big // 2 - small // 2 if upper else (big - small) // 2
        if n > m:
            where = where & (F.col(c) >= off) & (F.col(c) < off + m)
            exprs.append(F.col(c) - off)
        else:
            exprs.append(F.col(c) + off)
    return g.reindex(shape, where, *exprs).filled(shape, background)


def decimate_blocks(g: Grid, dim: int, blocks: int, points: int) -> Grid:
    """Drops `points` samples of each of `blocks` equal segments, half of them before those that stay."""
    n = g.shape[dim]
    if n % blocks or points > n // blocks:
        raise ShapeError("blocks must divide the axis and keep at least nothing of each segment")
    seg = n // blocks
    keep, lead = seg - points, points // 2
    c = F.col(g.index[dim])
    inside = c % seg - lead
    shape = tuple(blocks * keep if d == dim else k for d, k in enumerate(g.shape))
    return g.reindex(shape, (inside >= 0) & (inside < keep), *[F.floor(c / F.lit(seg)) * keep + inside if d == dim else F.col(x) for d, x in enumerate(g.index)])


# ---------------------------------------------------------------- differences
def forward_difference(g: Grid, dim: int, periodic: bool = False) -> Grid:
    """x[i + 1] - x[i]; at the end 0, or around to the first."""
    w = Window.partitionBy(*g.keys, *[c for d, c in enumerate(g.index) if d != dim]).orderBy(g.index[dim])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def diff(c: str) -> Column:
        end = F.first(c).over(whole) - F.col(c) if periodic else F.lit(0.0)
        return F.coalesce(F.lead(c).over(w) - F.col(c), end).alias(c)

    return replace(g, df=g.df.select(*g.keys, *g.index, *[diff(c) for c in g.values]))


def adjoint_forward_difference(g: Grid, dim: int, periodic: bool = False) -> Grid:
    """The transpose of forward_difference(): y[i - 1] - y[i], where the last y counts only if periodic."""
    n, c0 = g.shape[dim], g.index[dim]
    w = Window.partitionBy(*g.keys, *[c for d, c in enumerate(g.index) if d != dim]).orderBy(c0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def diff(c: str) -> Column:
        own = F.col(c) if periodic else F.when(F.col(c0) == n - 1, F.lit(0.0)).otherwise(F.col(c))
        before = F.lag(c).over(w)
        return (F.coalesce(before, F.last(c).over(whole) if periodic else F.lit(0.0)) - own).alias(c)

    return replace(g, df=g.df.select(*g.keys, *g.index, *[diff(c) for c in g.values]))


# ---------------------------------------------------------------- axis products
def multiply_by_trailing(g: Grid, other: Grid) -> Grid:
    """g[i0, i1, ...] * other[i1, ...]: broadcast over the first axis. The smaller array is joined on the trailing axes."""
    if g.shape[1:] != other.shape:
        raise ShapeError(f"{other.shape} is not the trailing shape of {g.shape}")
    on = [*[k for k in g.keys if k in other.keys], *g.index[1:]]
    renamed = other.df.select(*other.keys, *[F.col(c).alias(n) for c, n in zip(other.index, g.index[1:], strict=True)], *[F.col(c).alias(f"r_{c}") for c in other.values])
    both = g.df.join(renamed, on)
    if g.is_complex or other.is_complex:
        z = lambda s, c: (F.col(f"{s}re"), F.col(f"{s}im")) if c else (F.col(f"{s}v"), F.lit(0.0))
        re, im = cplx.multiply(*z("", g.is_complex), *z("r_", other.is_complex))
        return replace(g, df=both.select(*g.keys, *g.index, re.alias("re"), im.alias("im")), is_complex=True)
    return replace(g, df=both.select(*g.keys, *g.index, (F.col("v") * F.col("r_v")).alias("v")))


multiply_array4d_by_cube = multiply_by_trailing


def multiply_cube_by_array4d(cube: Grid, array4d: Grid) -> Grid:
    return multiply_by_trailing(array4d, cube)


def multiply_cube_by_abs_sum_squared(cube: Grid, array4d: Grid) -> Grid:
    """cube times the square of the summed magnitudes over the first axis of the other."""
    total = reduce_axis(array4d, 0, lambda *z: F.sum(F.abs(z[0]) if len(z) == 1 else F.hypot(*z)))
    squared = total.map(lambda v: v * v)
    return cube.zip(squared, (lambda re, im, s: (re * s, im * s)) if cube.is_complex else (lambda v, s: v * s))


def reduce_conjugate_product(left: Grid, right: Grid) -> Grid:
    """Sum over the first axis of left conj(right)."""
    both = left.zip(right, cplx.multiply_conjugate)
    return reduce_axis(both, 0, lambda re, im: (F.sum(re), F.sum(im)))


def broadcast_abs_presence_mask(g: Grid, threshold: float, over: tuple[int, ...] = (0, 2)) -> Grid:
    """1 where any magnitude over the axes is above the threshold, put back on all axes but the first."""
    mag = F.abs(F.col("v")) if not g.is_complex else F.hypot("re", "im")
    keep = [c for d, c in enumerate(g.index) if d not in over]
    w = Window.partitionBy(*g.keys, *keep)
    df = g.df.withColumn("v", F.max(F.when(mag > threshold, 1.0).otherwise(0.0)).over(w)).where("i0 = 0")
    rest = g.index[1:]
    return Grid(df.select(*g.keys, *[F.col(c).alias(n) for c, n in zip(rest, index_names(len(rest)), strict=True)], "v"), g.shape[1:], g.keys)


def copy_block_split(g: Grid, block_dim: int, block: int, split_dim: int, parts: int) -> Grid:
    """One position of block_dim; split_dim becomes two axes (parts, rest)."""
    one = select_index(g, block_dim, block)
    d = split_dim - (split_dim > block_dim)
    inner = one.shape[d] // parts
    shape = (*one.shape[:d], parts, inner, *one.shape[d + 1 :])
    exprs = []
    for k, c in enumerate(one.index):
        exprs += [F.floor(F.col(c) / F.lit(inner)), F.col(c) % inner] if k == d else [F.col(c)]
    return one.reindex(shape, None, *exprs)


def sliding_patches(g: Grid, sizes: tuple[int, ...]) -> Grid:
    """A matrix of all windows: a row a position of the window, a column a place in it, both in row-major order."""
    spans = [n - k + 1 for n, k in zip(g.shape, sizes, strict=True)]
    if min(spans) < 1:
        raise ShapeError(f"windows of {sizes} in {g.shape}")
    df, row, col = g.df, F.lit(0), F.lit(0)
    for c, n, k, s in zip(g.index, g.shape, sizes, spans, strict=True):
        lo, hi = F.greatest(F.col(c) - (s - 1), F.lit(0)), F.least(F.col(c), F.lit(k - 1))
        df = df.withColumn(f"o_{c}", F.explode(F.sequence(lo, hi)))
        row, col = row * s + (F.col(c) - F.col(f"o_{c}")), col * k + F.col(f"o_{c}")
    shape = (int(_product(spans)), int(_product(sizes)))
    return replace(g, df=df.select(*g.keys, row.cast("int").alias("i0"), col.cast("int").alias("i1"), *g.values), shape=shape)


def _product(xs) -> int:
    out = 1
    for x in xs:
        out *= x
    return out


def extract_sliding_window_matrix(cube: Grid, rows: int, cols: int) -> Grid:
    """Windows over the first two axes, with all of the third."""
    return sliding_patches(cube, (rows, cols, cube.shape[2]))


def extract_sliding_patch_matrix(g: Grid, *kernel: int) -> Grid:
    """Patches over all axes but the first, whose elements follow each other in the columns."""
    return sliding_patches(g, (g.shape[0], *kernel))


# ---------------------------------------------------------------- indexing
def count_matching(g: Grid, pred: Callable[..., Column]) -> DataFrame:
    return g.df.groupBy(*g.keys).agg(F.count_if(pred(*[F.col(c) for c in g.values])).alias("n"))


def find_linear_indices(g: Grid, pred: Callable[..., Column]) -> DataFrame:
    return g.df.where(pred(*[F.col(c) for c in g.values])).select(*g.keys, g.linear().cast("long").alias("lin"))


def gather(g: Grid, indices: DataFrame) -> DataFrame:
    """indices (keys, j, lin) with the values found at their linear positions; one out of bounds is an error."""
    at = g.df.select(*g.keys, g.linear().cast("long").alias("lin"), *g.values)
    found = indices.join(at.withColumn("has", F.lit(True)), [*g.keys, "lin"], "left")
    fail = F.raise_error(F.lit("an index is out of bounds")).cast("double")
    return found.select(*g.keys, "j", *[F.when(F.col("has"), F.col(c)).otherwise(fail).alias(c) for c in g.values])


take = gather_linear_indices = gather


def scatter(g: Grid, writes: DataFrame) -> Grid:
    """writes (keys, j, lin, values) put into g; of several for one place the largest j wins."""
    last = writes.groupBy(*g.keys, "lin").agg(*[F.max_by(c, "j").alias(f"w_{c}") for c in g.values]).withColumn("hit", F.lit(True))
    df = g.df.withColumn("lin", g.linear().cast("long")).join(last, [*g.keys, "lin"], "left")
    return replace(g, df=df.select(*g.keys, *g.index, *[F.when(F.col("hit"), F.col(f"w_{c}")).otherwise(F.col(c)).alias(c) for c in g.values]))


scatter_linear_indices = scatter


def fill_linear_indices(g: Grid, indices: DataFrame, value: float) -> Grid:
    hit = indices.select(*g.keys, "lin").distinct().withColumn("hit", F.lit(True))
    df = g.df.withColumn("lin", g.linear().cast("long")).join(hit, [*g.keys, "lin"], "left")
    return replace(g, df=df.select(*g.keys, *g.index, *[F.when(F.col("hit"), F.lit(float(value))).otherwise(F.col(c)).alias(c) for c in g.values]))


def true_runs(g: Grid, pred: Callable[..., Column], least: int = 1) -> DataFrame:
    """keys, first, last (inclusive) of each run of at least `least` elements of a vector that hold."""
    w = Window.partitionBy(*g.keys).orderBy("i0")
    flagged = g.df.withColumn("hit", pred(*[F.col(c) for c in g.values])).withColumn("n", F.row_number().over(w))
    hits = flagged.where("hit").withColumn("island", F.col("i0") - F.row_number().over(w))
    runs = hits.groupBy(*g.keys, "island").agg(F.min("i0").alias("first"), F.max("i0").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= least).drop("island")


find_true_run_bounds = true_runs


def count_true_runs(g: Grid, pred: Callable[..., Column], least: int = 1) -> DataFrame:
    return true_runs(g, pred, least).groupBy(*g.keys).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- reductions
def reduce_axis(g: Grid, dim: int, f: Callable[..., Column]) -> Grid:
    """An aggregate over one axis, which goes."""
    keep = [d for d in range(g.rank) if d != dim]
    got = f(*[F.col(c) for c in g.values])
    pair = isinstance(got, tuple)
    cols = [got[0].alias("re"), got[1].alias("im")] if pair else [got.cast("double").alias("v")]
    df = g.df.groupBy(*g.keys, *[g.index[d] for d in keep]).agg(*cols)
    df = df.select(*g.keys, *[F.col(g.index[d]).alias(n) for d, n in zip(keep, index_names(len(keep)), strict=True)], *(["re", "im"] if pair else ["v"]))
    return Grid(df, tuple(g.shape[d] for d in keep), g.keys, pair)


def sum_axis(g: Grid, dim: int) -> Grid:
    return reduce_axis(g, dim, (lambda re, im: (F.sum(re), F.sum(im))) if g.is_complex else F.sum)


def min_axis(g: Grid, dim: int) -> Grid:
    return reduce_axis(g, dim, F.min)


def max_axis(g: Grid, dim: int) -> Grid:
    return reduce_axis(g, dim, F.max)


def argmin_axis(g: Grid, dim: int) -> Grid:
    """The first place of the least element along an axis."""
    c = F.col(g.index[dim])
    return reduce_axis(g, dim, lambda v: F.min_by(c, F.struct(v, c)))


def argmax_axis(g: Grid, dim: int) -> Grid:
    c = F.col(g.index[dim])
    return reduce_axis(g, dim, lambda v: F.min_by(c, F.struct(-v, c)))


def argmin_groups(g: Grid, groups: int) -> Grid:
    """The last axis is `groups` runs of one length, one after the other: at each place of a run the number of the run with the
    least element, the first of equals."""
    if groups == 0 or g.shape[2] % groups:
        raise ShapeError(f"{groups} groups of an axis of {g.shape[2]}")
    groups = g.shape[2] // groups
    df = g.df.withColumn("at", F.floor(F.col("i2") / F.lit(groups)).cast("int")).withColumn("i2", (F.col("i2") % groups).cast("int"))
    out = df.groupBy(*g.keys, "i0", "i1", "i2").agg(F.min_by("at", F.struct("v", "at")).cast("double").alias("v"))
    return replace(g, df=out, shape=(*g.shape[:2], groups))


def sum_product_across(a: Grid, b: Grid, dim: int = 2) -> Grid:
    return sum_axis(a.zip(b, lambda x, y: x * y), dim)


def squared_norm_across(g: Grid, dim: int) -> Grid:
    return reduce_axis(g, dim, lambda *z: F.sum(z[0] * z[0] + (z[1] * z[1] if len(z) > 1 else 0.0)))


def root_sum_of_squares_across(g: Grid, dim: int) -> Grid:
    return squared_norm_across(g, dim).map(F.sqrt)


sum_of_squares_across = squared_norm_across


def count_not_equal(a: Grid, b: Grid) -> DataFrame:
    return count_matching(a.zip(b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)), lambda v: v == 1.0)


def forward_difference_stats_below_threshold(g: Grid, mask: Grid, dim: int, threshold: float) -> DataFrame:
    """Sum and number of the differences to the element before along an axis that are smaller in size than the threshold and
    whose later element is in the mask (above 0)."""
    both = g.zip(mask, lambda v, m: (v, m))
    w = Window.partitionBy(*g.keys, *[c for d, c in enumerate(g.index) if d != dim]).orderBy(g.index[dim])
    df = both.df.select(*g.keys, (F.col("re") - F.lag("re").over(w)).alias("d"), (F.col("im") > 0).alias("m"))
    ok = F.col("m") & (F.abs("d") < threshold)
    return df.groupBy(*g.keys).agg(F.coalesce(F.sum(F.when(ok, F.col("d"))), F.lit(0.0)).alias("total"), F.count_if(ok).alias("n"))


def accumulate(g: Grid, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A fold over the elements in row-major order, for steps whose order matters: over the packed form of one array."""
    return g.pack().select(*g.keys, F.aggregate(g.values[0], start, step).alias("v"))


def transform_linear_indexed(g: Grid, f: Callable[..., Column]) -> Grid:
    """f(row-major position, value)."""
    return g.map(lambda *v: f(g.linear(), *v))


def transform_indexed(g: Grid, f: Callable[..., Column]) -> Grid:
    """f(i0, ..., value)."""
    return g.map(lambda *v: f(*[F.col(c) for c in g.index], *v))


def for_each(g: Grid, f: Callable) -> None:
    """f on each row, in the executors."""
    g.df.foreach(f)


def for_each_contiguous_block(g: Grid, f: Callable) -> None:
    """f on each array's packed row, in the executors."""
    g.pack().foreach(f)


def for_each_zip(a: Grid, b: Grid, f: Callable) -> None:
    """f on each pair of elements (as re and im), in the executors."""
    a.zip(b, lambda x, y: (x, y)).df.foreach(f)
