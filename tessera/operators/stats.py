"""Aggregates over the elements of arrays, one row an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.grid import Grid


def magnitude(g: Grid) -> Column:
    return F.hypot("re", "im") if g.is_complex else F.abs(F.col("v"))


def power(g: Grid) -> Column:
    return F.col("re") * F.col("re") + F.col("im") * F.col("im") if g.is_complex else F.col("v") * F.col("v")


def summary(g: Grid, **aggs: Column) -> DataFrame:
    return g.df.groupBy(*g.keys).agg(*[c.alias(n) for n, c in aggs.items()])


def total(g: Grid) -> DataFrame:
    return summary(g, re=F.sum("re"), im=F.sum("im")) if g.is_complex else summary(g, total=F.sum("v"))


def exact_total(g: Grid) -> DataFrame:
    """A sum that does not depend on the order of elements: in decimals of 12 places."""
    return summary(g, total=F.sum(F.col("v").cast("decimal(26,12)")).cast("double"))


kahan_sum = pair_sum = exact_total


def mean(g: Grid) -> DataFrame:
    return summary(g, re=F.avg("re"), im=F.avg("im")) if g.is_complex else summary(g, mean=F.avg("v"))


def mean_stddev(g: Grid) -> DataFrame:
    return summary(g, mean=F.avg("v"), stddev=F.stddev_pop("v"))


def variance(g: Grid, sample: bool = True) -> DataFrame:
    return summary(g, variance=(F.var_samp if sample else F.var_pop)("v"))


def sum_abs(g: Grid) -> DataFrame:
    return summary(g, total=F.sum(magnitude(g)))


norm_l1 = sum_abs


def sum_of_squares(g: Grid) -> DataFrame:
    return summary(g, total=F.sum(power(g)))


squared_norm = squared_l2_norm = sum_of_squares


def root_sum_of_squares(g: Grid) -> DataFrame:
    return summary(g, norm=F.sqrt(F.sum(power(g))))


norm = norm_l2 = root_sum_of_squares


def max_abs(g: Grid) -> DataFrame:
    return summary(g, norm=F.max(magnitude(g)))


norm_inf = max_abs


def difference(a: Grid, b: Grid) -> Grid:
    return a.zip(b, (lambda p, q, r, s: (p - r, q - s)) if a.is_complex else (lambda x, y: x - y))


def l1_distance(a: Grid, b: Grid) -> DataFrame:
    return sum_abs(difference(a, b))


def l2_distance(a: Grid, b: Grid) -> DataFrame:
    return root_sum_of_squares(difference(a, b))


def linf_distance(a: Grid, b: Grid) -> DataFrame:
    return max_abs(difference(a, b))


def squared_distance(a: Grid, b: Grid) -> DataFrame:
    return sum_of_squares(difference(a, b))


squared_l2_distance = squared_distance
norm_diff_l1, norm_diff_l2, norm_diff_inf = l1_distance, l2_distance, linf_distance


def rmse(a: Grid, b: Grid | None = None) -> DataFrame:
    d = a if b is None else difference(a, b)
    return summary(d, rmse=F.sqrt(F.avg(power(d))))


def all_close(a: Grid, b: Grid, tolerance: float) -> DataFrame:
    d = difference(a, b)
    return summary(d, close=F.bool_and(magnitude(d) <= tolerance))


equal = all_close


def min_max(g: Grid) -> DataFrame:
    return summary(g, least=F.min("v"), most=F.max("v"))


def extremes(g: Grid) -> DataFrame:
    """Least and most by value, or by magnitude for complex arrays, with the first place of each."""
    key = magnitude(g) if g.is_complex else F.col("v")
    lin = g.linear().cast("long")
    return summary(g, least=F.min(key), least_at=F.min_by(lin, F.struct(key, lin)), most=F.max(key), most_at=F.min_by(lin, F.struct(-key, lin)))


def min_index(g: Grid) -> DataFrame:
    return extremes(g).select(*g.keys, "least_at")


def max_index(g: Grid) -> DataFrame:
    return extremes(g).select(*g.keys, "most_at")


def count_nonzero(g: Grid) -> DataFrame:
    return summary(g, n=F.count_if(power(g) != 0))


def all_of(g: Grid, pred) -> DataFrame:
    return summary(g, holds=F.bool_and(pred(*[F.col(c) for c in g.values])))


def any_of(g: Grid, pred) -> DataFrame:
    return summary(g, holds=F.bool_or(pred(*[F.col(c) for c in g.values])))


def accumulate_if(g: Grid, pred) -> DataFrame:
    return summary(g, total=F.coalesce(F.sum(F.when(pred(F.col("v")), F.col("v"))), F.lit(0.0)))


def centered_magnitude_average(g: Grid, rows: int, cols: int) -> DataFrame:
    """The mean magnitude over a centred box of the first two axes."""
    r0, c0 = (g.shape[0] - rows) // 2, (g.shape[1] - cols) // 2
    box = F.col("i0").between(r0, r0 + rows - 1) & F.col("i1").between(c0, c0 + cols - 1)
    return g.df.where(box).groupBy(*g.keys).agg(F.avg(magnitude(g)).alias("mean"))


def covariance(a: Grid, b: Grid, sample: bool = True) -> DataFrame:
    """Of two real vectors."""
    both = a.zip(b, lambda x, y: (x, y))
    return both.df.groupBy(*a.keys).agg((F.covar_samp if sample else F.covar_pop)("re", "im").alias("covariance"))


def linear_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and intercept of y on x by sums that merge; null under two points or if all x agree."""
    return points.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


# ---------------------------------------------------------------- thresholds
def otsu_threshold(g: Grid, bins: int = 256) -> DataFrame:
    """keys, threshold: the first of `bins` floor-scaled bins with the largest between-class variance, as a value; a constant
    array gives its value. Counts by bin are at most `bins` rows an array."""
    ends = g.df.groupBy(*g.keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    df = (g.df.join(ends, list(g.keys)) if g.keys else g.df.crossJoin(F.broadcast(ends))).where("hi > lo")
    scale = F.lit(float(bins - 1)) / (F.col("hi") - F.col("lo"))
    hist = df.groupBy(*g.keys, "lo", "hi", F.floor((F.col("v") - F.col("lo")) * scale).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*g.keys)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.select("*", F.sum("n").over(run).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(run).alias("s0"), F.sum("n").over(w).alias("n_all"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s_all"))
    w1 = F.col("n_all") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - F.when(w1 > 0, (F.col("s_all") - F.col("s0")) / F.when(w1 > 0, w1)).otherwise(F.lit(0.0))
    between = F.col("w0").cast("double") * w1 * gap * gap
    best = h.where(w1 > 0).groupBy(*g.keys, "lo", "hi").agg(F.min_by("bin", F.struct(-between, "bin")).alias("bin"))
    found = best.select(*g.keys, (F.col("lo") + F.col("bin") / (F.lit(float(bins - 1)) / (F.col("hi") - F.col("lo")))).alias("threshold"))
    return found.union(ends.where("hi = lo").select(*g.keys, F.col("lo").alias("threshold")))


def split_points(df: DataFrame, value: str, parts: int = 128) -> list[float]:
    """Up to `parts` - 1 approximate quantiles of a numeric column: one small row reaches the driver."""
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 10_000).alias("s")).first()
    return sorted(set(row.s or []))


def bucket_of(value: str, splits: list[float]) -> Column:
    """How many split points are below a value, by halves."""
    v = F.col(value).cast("double")

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > F.lit(float(splits[mid])), part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(splits))


def midpoint_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The percentile by the midpoint rule: position p n / 100 - 1/2 from 0, between neighbours in proportion.

    Equal values are counted first, on the map side; ranks then run over ranges of values, and the counts of the ranges over
    each other, so that a key with most of the rows never meets in one task."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", bucket_of(value, split_points(counted, value)))
    of_key = Window.partitionBy(*keys)
    sizes = parts.groupBy(*keys, "part").agg(F.sum("n").alias("here"))
    sizes = sizes.select(*keys, "part", (F.sum("here").over(of_key.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(of_key).alias("all"))
    ranked = parts.join(sizes, [*keys, "part"]).withColumn("end", F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value)) + F.col("before"))
    at = F.greatest(F.least(F.lit(p / 100.0) * F.col("all") - 0.5, F.col("all") - 1.0), F.lit(0.0))
    lo = F.floor(at)
    holds = lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end"))
    out = ranked.groupBy(*keys).agg(F.max(F.when(holds(lo), F.col(value))).alias("a"), F.max(F.when(holds(F.least(lo + 1, F.col("all") - 1)), F.col(value))).alias("b"), F.max(at - lo).alias("t"))
    return out.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias(name))
