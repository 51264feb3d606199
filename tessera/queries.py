"""Queries by name over the driver's tables, and for each the SQL that DuckDB must agree with.

The tables stand for arrays: an embedding of 64 numbers is an 8 x 8 image (its key vec_id) or 32 complex points; events of a
user in order of time are a signal; line items are lines of frames keyed by order, sparse matrices, or complex numbers of
price and discount. Results in floating point are rounded alike on both sides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import diagnostics
from tessera.functions import cplx, special
from tessera.functions import elementwise as el
from tessera.functions import windows as win
from tessera.grid import Grid, from_arrays, unpacked
from tessera.operators import arrays, fft, image, ingest, linalg, nufft, recon, signal, sparse, stats
from tessera.plans import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            # DuckDB reads 0.5 as a decimal: every literal with a point is meant as a double
            ORACLES[name] = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.:])", r"\1::DOUBLE", sql)
        return f

    return wrap


# ---------------------------------------------------------------- inputs
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def images(spark: SparkSession, sf: str, shape: tuple[int, ...] = (8, 8)) -> Grid:
    return from_arrays(table(spark, sf, "embeddings"), "embedding", shape, ("vec_id",))


def complex_images(spark: SparkSession, sf: str, shape: tuple[int, ...] = (4, 8)) -> Grid:
    """The first half of each embedding as real parts, the second as imaginary ones."""
    e = table(spark, sf, "embeddings")
    packed = e.select("vec_id", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("re"), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")).alias("im"))
    return unpacked(packed, shape, ("vec_id",), True)


def coils(spark: SparkSession, sf: str) -> DataFrame:
    """label, channel, i0, i1, re, im: the vectors of a label, in order of vec_id, are the channels of a frame."""
    e = table(spark, sf, "embeddings").select("vec_id", "label").withColumn("channel", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int"))
    return complex_images(spark, sf).df.join(e, "vec_id")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, i0, v: a user's event values in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", (F.row_number().over(w) - 1).cast("int").alias("i0"), F.col("value").alias("v"))


PX = "px AS (SELECT vec_id, label, (i // 8)::INT AS i0, (i % 8)::INT AS i1, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"
CX = "cx AS (SELECT vec_id, label, (i // 8)::INT AS i0, (i % 8)::INT AS i1, embedding[i + 1]::DOUBLE AS re, embedding[i + 33]::DOUBLE AS im FROM embeddings, range(32) r(i))"
SIG = "sig AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS i0, value AS v FROM events)"
CH = "ch AS (SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS channel FROM embeddings)"


def rnd(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def R(e: str, digits: int = 6) -> str:
    return f"(round(CAST({e} AS DOUBLE), {digits}) + 0.0)"


def shown(g: Grid, digits: int = 6) -> DataFrame:
    return g.df.select(*g.keys, *g.index, *[rnd(c, digits).alias(c) for c in g.values])


# ---------------------------------------------------------------- pointwise
def pointwise(name: str, f: Callable[..., Column], sql: str, digits: int = 6) -> None:
    """A function of v over all pixels."""

    def run(spark, sf):
        return shown(images(spark, sf).map(f), digits)

    query(name, f"WITH {PX} SELECT vec_id, i0, i1, {R(sql, digits)} AS v FROM px")(run)


POINTWISE = {
    "absolute": (el.absolute, "abs(v)"), "square": (el.square, "v * v"), "negate": (el.negate, "-v"), "sqrt_abs": (lambda v: el.sqrt(F.abs(v)), "sqrt(abs(v))"),
    "inverse": (lambda v: el.inverse(v + 10.0), "1 / (v + 10)"), "rsqrt": (lambda v: el.rsqrt(F.abs(v) + 1.0), "1 / sqrt(abs(v) + 1)"),
    "exp": (el.exp, "exp(v)"), "log": (lambda v: el.log(F.abs(v) + 0.5), "ln(abs(v) + 0.5)"), "add_scalar": (lambda v: el.add_scalar(v, 1.5), "v + 1.5"),
    "subtract_scalar": (lambda v: el.subtract_scalar(v, 1.5), "v - 1.5"), "scale": (lambda v: el.scale(v, -2.5), "v * -2.5"), "divide_scalar": (lambda v: el.divide_scalar(v, 3.0), "v / 3"),
    "scalar_subtract": (lambda v: el.scalar_subtract(v, 1.0), "1 - v"), "scalar_divide": (lambda v: el.scalar_divide(v + 10.0, 2.0), "2 / (v + 10)"),
    "clamp": (lambda v: el.clamp(v, -0.1, 0.1), "CASE WHEN v < -0.1 THEN -0.1 WHEN v > 0.1 THEN 0.1 ELSE v END"),
    "soft_threshold": (lambda v: el.soft_threshold(v, 0.05), "CASE WHEN abs(v) < 1e-9 THEN 0 ELSE v / abs(v) * greatest(abs(v) - 0.05, 0) END"),
    "minimum": (lambda v: el.minimum(v, 0.02), "CASE WHEN 0.02 < v THEN 0.02 ELSE v END"), "maximum": (lambda v: el.maximum(v, 0.02), "CASE WHEN v < 0.02 THEN 0.02 ELSE v END"),
    "hypot": (lambda v: el.hypot(v, 0.5), "sqrt(v * v + 0.25)"), "threshold": (lambda v: el.threshold(v, 0.01, 2.0, -1.0), "CASE WHEN v >= 0.01 THEN 2 ELSE -1 END"),
    "floor_mod": (lambda v: el.floor_mod(v * 10.0, 0.7), "v * 10 - floor(v * 10 / 0.7) * 0.7"), "round_value": (lambda v: el.round_value(v * 10.0), "sign(v) * floor(abs(v * 10) + 0.5)"),
    "order": (lambda v: el.order(v), "CASE WHEN v <> 0 THEN ceil(log10(abs(v))) END"),
    "wrap_phase": (lambda v: el.wrap_phase(v * 50.0), f"v * 50 - {2 * math.pi!r} * ceil((v * 50 - {math.pi!r}) / {2 * math.pi!r})"),
    "lerp": (lambda v: el.lerp(v, 1.0, 0.25), "v + (1 - v) * 0.25"), "linear_combination": (lambda v: el.linear_combination((v, 2.0), (v * v, -1.0), (1.0, 0.5)), "2 * v - v * v + 0.5"),
    "multiply_accumulate": (lambda v: el.multiply_accumulate(1.0, v, v), "1 + v * v"), "add_subtract": (lambda v: el.add_subtract(v, 1.0, v * v), "v + 1 - v * v"), "scale_add": (lambda v: el.scale_add(v, 3.0, 1.0), "3 * v + 1"),
    "sin": (special.sin, "sin(v)"), "cos": (special.cos, "cos(v)"), "tan": (special.tan, "tan(v)"), "atan": (special.atan, "atan(v)"), "asin": (lambda v: special.asin(el.clamp(v, -1.0, 1.0)), "asin(greatest(least(v, 1), -1))"),
    "acos": (lambda v: special.acos(el.clamp(v, -1.0, 1.0)), "acos(greatest(least(v, 1), -1))"), "atan2": (lambda v: special.atan2(v, 0.3), "atan2(v, 0.3)"), "exp2": (special.exp2, "pow(2, v)"),
    "expm1": (special.expm1, "exp(v) - 1"), "log1p": (lambda v: special.log1p(F.abs(v)), "ln(1 + abs(v))"), "log2": (lambda v: special.log2(F.abs(v) + 1.0), "log2(abs(v) + 1)"), "log10": (lambda v: special.log10(F.abs(v) + 1.0), "log10(abs(v) + 1)"),
    "cbrt": (special.cbrt, "cbrt(v)"), "pow": (lambda v: special.pow(F.abs(v), 1.5), "pow(abs(v), 1.5)"), "sinpi": (lambda v: special.sinpi(v * 4.0), f"sin({math.pi!r} * v * 4)"), "cospi": (lambda v: special.cospi(v * 4.0), f"cos({math.pi!r} * v * 4)"),
    "gamma": (lambda v: special.gamma(F.abs(v) + 1.0), "gamma(abs(v) + 1)"), "log_gamma": (lambda v: special.log_gamma(F.abs(v) + 1.0), "lgamma(abs(v) + 1)"),
}
for _n, (_f, _s) in POINTWISE.items():
    pointwise(f"elementwise_{_n}", _f, _s)


@query("elementwise_bitwise", "SELECT l_orderkey, l_linenumber, l_partkey & l_suppkey AS both, ~l_partkey AS inverted FROM lineitem")
def _(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", el.bitwise_and(F.col("l_partkey"), F.col("l_suppkey")).alias("both"), el.bitwise_not(F.col("l_partkey")).alias("inverted"))


@query("elementwise_where_replace_nan", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE 0.0 END AS kept, CASE WHEN p_size = 1 THEN -1.0 ELSE p_retailprice END AS replaced, p_size <> 1 AS finite FROM part")
def _(spark, sf):
    t = table(spark, sf, "part").withColumn("x", F.when(F.col("p_size") == 1, F.lit(float("nan"))).otherwise(F.col("p_retailprice")))
    return t.select("p_partkey", el.where(F.col("p_size") > 25, F.col("p_retailprice"), 0.0).alias("kept"), el.replace_nan(F.col("x"), -1.0).alias("replaced"), el.isfinite(F.col("x")).alias("finite"))


# ---------------------------------------------------------------- complex
def complexwise(name: str, f, sql: str | tuple[str, str]) -> None:
    pair = isinstance(sql, tuple)
    cols = f"{R(sql[0])} AS re, {R(sql[1])} AS im" if pair else f"{R(sql)} AS v"

    @query(f"complex_{name}", f"WITH {CX} SELECT vec_id, i0, i1, {cols} FROM cx")
    def run(spark, sf):
        return shown(complex_images(spark, sf).map(f))


_M = "sqrt(re * re + im * im)"
COMPLEX = {
    "real": (cplx.real, "re"), "imag": (cplx.imag, "im"), "magnitude": (cplx.magnitude, _M), "squared_magnitude": (cplx.squared_magnitude, "re * re + im * im"), "phase": (cplx.phase, "atan2(im, re)"),
    "conjugate": (cplx.conjugate, ("re", "-im")), "soft_threshold": (lambda a, b: cplx.soft_threshold(a, b, 0.1), (f"CASE WHEN {_M} < 1e-9 THEN 0 ELSE re / {_M} * greatest({_M} - 0.1, 0) END", f"CASE WHEN {_M} < 1e-9 THEN 0 ELSE im / {_M} * greatest({_M} - 0.1, 0) END")),
    "normalize_phase": (cplx.normalize_complex_phase, (f"re / {_M}", f"im / {_M}")), "unit_phasor_of": (lambda a, b: cplx.complex_unit_phasor(a, b, 0.1), (f"CASE WHEN {_M} > 0.1 THEN re / {_M} ELSE 0 END", f"CASE WHEN {_M} > 0.1 THEN im / {_M} ELSE 0 END")),
    "rectangular_to_polar": (cplx.rectangular_to_polar, (_M, "atan2(im, re)")), "polar_to_rectangular": (cplx.polar_to_rectangular, ("re * cos(im)", "re * sin(im)")), "unit_phasor": (lambda a, b: cplx.unit_phasor(b), ("cos(im)", "sin(im)")),
    "multiply": (lambda a, b: cplx.multiply(a, b, b, a), ("re * im - im * re", "re * re + im * im")), "multiply_conjugate": (lambda a, b: cplx.multiply_conjugate(a, b, b, a), ("re * im + im * re", "im * im - re * re")),
    "reflect_about": (lambda a, b: cplx.reflect_complex_about(a, b, F.lit(3.0), F.lit(4.0)), ("2 * (re * 0.6 + im * 0.8) * 0.6 - re", "2 * (re * 0.6 + im * 0.8) * 0.8 - im")),
    "absolute_phase_difference": (lambda a, b: cplx.absolute_phase_difference(a, b, F.lit(1.0), F.lit(0.0)), "abs(atan2(im, re))"),
    "conjugate_product_scaled": (lambda a, b: cplx.conjugate_product_scaled(a, b, F.lit(1.0), F.lit(2.0), 3.0), ("(re + im * 2) * 3", "(re * 2 - im) * 3")),
    "accumulate_conjugate_product_divided": (lambda a, b: cplx.accumulate_conjugate_product_divided(F.lit(1.0), F.lit(0.0), a, b, F.lit(1.0), F.lit(2.0), 4.0), ("1 + (re + im * 2) / 4", "(re * 2 - im) / 4")),
    "exp": (cplx.exp, ("exp(re) * cos(im)", "exp(re) * sin(im)")),
}
for _n, (_f, _s) in COMPLEX.items():
    complexwise(_n, _f, _s)


@query("complex_zip_divide", f"WITH {CX} SELECT a.vec_id, a.i0, a.i1, {R('(a.re * b.re + a.im * b.im) / (b.re * b.re + b.im * b.im)', 4)} AS re, {R('(a.im * b.re - a.re * b.im) / (b.re * b.re + b.im * b.im)', 4)} AS im FROM cx a JOIN (SELECT vec_id, i0, i1, re + 5 AS re, im FROM cx) b USING (vec_id, i0, i1)")
def _(spark, sf):
    g = complex_images(spark, sf)
    return shown(g.zip(g.map(lambda a, b: (a + 5.0, b)), cplx.divide_complex), 4)


# ---------------------------------------------------------------- reshaping
def reindexed(name: str, f: Callable[[Grid], Grid], sql: str) -> None:
    @query(f"array_{name}", f"WITH {PX} {sql}")
    def run(spark, sf):
        return f(images(spark, sf)).df


REINDEX = {
    "transpose": (arrays.transpose, "SELECT vec_id, i1 AS i0, i0 AS i1, v FROM px"), "reverse_rows": (arrays.reverse_rows, "SELECT vec_id, 7 - i0 AS i0, i1, v FROM px"), "reverse_cols": (arrays.reverse_cols, "SELECT vec_id, i0, 7 - i1 AS i1, v FROM px"),
    "rotate_180": (arrays.rotate_180, "SELECT vec_id, 7 - i0 AS i0, 7 - i1 AS i1, v FROM px"), "transpose_rotated_180": (arrays.transpose_rotated_180, "SELECT vec_id, 7 - i1 AS i0, 7 - i0 AS i1, v FROM px"),
    "fftshift": (arrays.fftshift, "SELECT vec_id, (i0 + 4) % 8 AS i0, (i1 + 4) % 8 AS i1, v FROM px"), "roll": (lambda g: arrays.roll(g, 3, -1), "SELECT vec_id, (i0 + 3) % 8 AS i0, (i1 + 7) % 8 AS i1, v FROM px"),
    "ravel": (arrays.ravel, "SELECT vec_id, i0 * 8 + i1 AS i0, v FROM px"), "reshape": (lambda g: arrays.reshape(g, 2, 4, 8), "SELECT vec_id, (i0 // 4)::INT AS i0, i0 % 4 AS i1, i1 AS i2, v FROM px"),
    "slice": (lambda g: arrays.slice_axis(g, 1, 1, 8, 3), "SELECT vec_id, i0, ((i1 - 1) // 3)::INT AS i1, v FROM px WHERE i1 >= 1 AND (i1 - 1) % 3 = 0"), "select_row": (lambda g: arrays.select_index(g, 0, 5), "SELECT vec_id, i1 AS i0, v FROM px WHERE i0 = 5"),
    "crop": (lambda g: arrays.crop(g, (1, 2), (4, 3)), "SELECT vec_id, i0 - 1 AS i0, i1 - 2 AS i1, v FROM px WHERE i0 BETWEEN 1 AND 4 AND i1 BETWEEN 2 AND 4"),
    "decimate_blocks": (lambda g: arrays.decimate_blocks(g, 1, 2, 2), "SELECT vec_id, i0, ((i1 // 4) * 2 + i1 % 4 - 1)::INT AS i1, v FROM px WHERE i1 % 4 BETWEEN 1 AND 2"),
    "copy_centered": (lambda g: arrays.copy_centered(g, (10, 5)), "SELECT k.vec_id, r::INT AS i0, c::INT AS i1, coalesce(p.v, 0) AS v FROM (SELECT DISTINCT vec_id FROM px) k CROSS JOIN range(10) a(r) CROSS JOIN range(5) b(c) LEFT JOIN px p ON p.vec_id = k.vec_id AND p.i0 = r - 1 AND p.i1 = c + 2"),
}
for _n, (_f, _s) in REINDEX.items():
    reindexed(_n, _f, _s)


@query("array_forward_difference", f"WITH {PX} SELECT vec_id, i0, i1, {R('coalesce(lead(v) OVER w - v, 0)')} AS plain, {R('coalesce(lead(v) OVER w, first_value(v) OVER w) - v')} AS periodic FROM px WINDOW w AS (PARTITION BY vec_id, i0 ORDER BY i1)")
def _(spark, sf):
    g = images(spark, sf)
    a, b = arrays.forward_difference(g, 1).df, arrays.forward_difference(g, 1, True).df
    return a.join(b.withColumnRenamed("v", "p"), ["vec_id", "i0", "i1"]).select("vec_id", "i0", "i1", rnd("v").alias("plain"), rnd("p").alias("periodic"))


@query("array_adjoint_forward_difference", f"WITH {PX} SELECT vec_id, i0, i1, {R('coalesce(lag(v) OVER w, 0) - CASE WHEN i0 = 7 THEN 0 ELSE v END')} AS v FROM px WINDOW w AS (PARTITION BY vec_id, i1 ORDER BY i0)")
def _(spark, sf):
    return shown(arrays.adjoint_forward_difference(images(spark, sf), 0))


@query("array_sliding_window_matrix", f"WITH {PX} SELECT vec_id, ((i0 - a) * 6 + i1 - b)::INT AS i0, (a * 3 + b)::INT AS i1, v FROM px, range(2) x(a), range(3) y(b) WHERE i0 - a BETWEEN 0 AND 6 AND i1 - b BETWEEN 0 AND 5")
def _(spark, sf):
    return arrays.sliding_patches(images(spark, sf), (2, 3)).df


@query("array_argmin_argmax", f"WITH {PX} SELECT vec_id, i0, arg_min(i1, (v, i1))::DOUBLE AS low, arg_min(i1, (-v, i1))::DOUBLE AS high FROM px GROUP BY 1, 2")
def _(spark, sf):
    g = images(spark, sf)
    return arrays.argmin_axis(g, 1).df.withColumnRenamed("v", "low").join(arrays.argmax_axis(g, 1).df.withColumnRenamed("v", "high"), ["vec_id", "i0"])


@query("array_axis_sums", f"WITH {PX} SELECT vec_id, i1 AS i0, {R('sum(v)')} AS total, {R('min(v)')} AS low, {R('max(v)')} AS high, {R('sum(v * v)')} AS power FROM px GROUP BY 1, 2")
def _(spark, sf):
    g = images(spark, sf)
    out = arrays.sum_axis(g, 0).df.withColumnRenamed("v", "total")
    for n, f in (("low", arrays.min_axis), ("high", arrays.max_axis), ("power", arrays.squared_norm_across)):
        out = out.join(f(g, 0).df.withColumnRenamed("v", n), ["vec_id", "i0"])
    return out.select("vec_id", "i0", *[rnd(c).alias(c) for c in ("total", "low", "high", "power")])


@query("array_find_and_gather", f"WITH {PX} SELECT vec_id, (i0 * 8 + i1)::BIGINT AS lin, {R('v')} AS v FROM px WHERE v > 0.1")
def _(spark, sf):
    g = images(spark, sf)
    lin = arrays.find_linear_indices(g, lambda v: v > 0.1).withColumn("j", F.col("lin"))
    return arrays.gather(g, lin).select("vec_id", F.col("j").alias("lin"), rnd("v").alias("v"))


@query("array_scatter_and_fill", f"WITH {PX} SELECT vec_id, i0, i1, {R('CASE WHEN i0 * 8 + i1 = 3 THEN 2.0 WHEN i0 = 1 THEN -1.0 ELSE v END')} AS v FROM px")
def _(spark, sf):
    g = images(spark, sf)
    keys = g.frames()
    writes = keys.crossJoin(F.broadcast(spark.createDataFrame([(0, 3, 1.0), (1, 3, 2.0)], "j int, lin long, v double")))
    fill = keys.crossJoin(F.broadcast(spark.range(8, 16).toDF("lin")))
    return shown(arrays.fill_linear_indices(arrays.scatter(g, writes), fill, -1.0))


@query("array_true_runs", f"WITH {SIG}, h AS (SELECT user_id, i0, i0 - row_number() OVER (PARTITION BY user_id ORDER BY i0) AS g FROM sig WHERE v > 20) SELECT user_id, min(i0) AS first, max(i0) AS last FROM h GROUP BY user_id, g HAVING count(*) >= 3")
def _(spark, sf):
    return arrays.true_runs(Grid(signals(spark, sf), (1,), ("user_id",)), lambda v: v > 20, 3)


@query("array_presence_mask", f"WITH {PX}, t AS (SELECT vec_id, (i0 // 4)::INT AS a, i0 % 4 AS b, i1 AS c, v FROM px) SELECT vec_id, b AS i0, c AS i1, max(CASE WHEN abs(v) > 0.15 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY vec_id, b) AS v FROM t QUALIFY a = 0")
def _(spark, sf):
    return arrays.broadcast_abs_presence_mask(images(spark, sf, (2, 4, 8)), 0.15).df


@query("array_conjugate_product_reduced", f"WITH {CX} SELECT a.vec_id, a.i1 AS i0, {R('sum(a.re * b.re + a.im * b.im)')} AS re, {R('sum(a.im * b.re - a.re * b.im)')} AS im FROM cx a JOIN (SELECT vec_id, 3 - i0 AS i0, i1, re, im FROM cx) b USING (vec_id, i0, i1) GROUP BY 1, 2")
def _(spark, sf):
    g = complex_images(spark, sf)
    return shown(arrays.reduce_conjugate_product(g, arrays.reverse_rows(g)))


@query("array_argmin_groups", f"WITH {PX} SELECT vec_id, (i0 // 4)::INT AS i0, i0 % 4 AS i1, (i1 % 4)::INT AS i2, arg_min(i1 // 4, (v, i1 // 4))::DOUBLE AS v FROM px GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return arrays.argmin_groups(images(spark, sf, (2, 4, 8)), 2).df


@query("array_block_split", f"WITH {PX} SELECT vec_id, (i1 // 2)::INT AS i0, i1 % 2 AS i1, v FROM px WHERE i0 = 2")
def _(spark, sf):
    return arrays.copy_block_split(images(spark, sf), 0, 2, 1, 4).df


@query("array_multiply_by_trailing", f"WITH {PX}, m AS (SELECT vec_id, i1, sum(v) AS s FROM px GROUP BY 1, 2) SELECT vec_id, i0, i1, {R('v * s')} AS v FROM px JOIN m USING (vec_id, i1)")
def _(spark, sf):
    g = images(spark, sf)
    return shown(arrays.multiply_by_trailing(g, arrays.sum_axis(g, 0)))


@query("array_difference_stats", f"WITH {PX}, d AS (SELECT vec_id, v - lag(v) OVER w AS d, v > -0.1 AS m FROM px WINDOW w AS (PARTITION BY vec_id, i0 ORDER BY i1)) SELECT vec_id, {R('coalesce(sum(d) FILTER (m AND abs(d) < 0.2), 0)')} AS total, count(*) FILTER (m AND abs(d) < 0.2) AS n FROM d GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    out = arrays.forward_difference_stats_below_threshold(g, g.map(lambda v: F.when(v > -0.1, 1.0).otherwise(0.0)), 1, 0.2)
    return out.select("vec_id", rnd("total").alias("total"), "n")


@query("array_linspace_identity", "SELECT (i // 5)::INT AS i0, (i % 5)::INT AS i1, round(1 + i * 2.0 / 24, 6) + 0.0 AS line, CASE WHEN i // 5 = i % 5 THEN 1.0 ELSE 0.0 END AS eye FROM range(25) r(i)")
def _(spark, sf):
    a, b = arrays.linspace(spark, (5, 5), 1.0, 3.0).df, arrays.identity(spark, 5, 5).df
    return a.join(b.withColumnRenamed("v", "eye"), ["i0", "i1"]).select("i0", "i1", rnd("v").alias("line"), "eye")


# ---------------------------------------------------------------- statistics
@query("stats_moments", f"WITH {PX} SELECT vec_id, {R('sum(v)')} AS total, {R('avg(v)')} AS mean, {R('var_samp(v)')} AS variance, {R('stddev_pop(v)')} AS stddev, {R('sum(abs(v))')} AS l1, {R('sqrt(sum(v * v))')} AS l2, {R('max(abs(v))')} AS linf, {R('sqrt(avg(v * v))')} AS rmse, count(*) FILTER (v <> 0) AS nonzero FROM px GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    v = F.col("v")
    out = stats.summary(g, total=F.sum(v), mean=F.avg(v), variance=F.var_samp(v), stddev=F.stddev_pop(v), l1=F.sum(F.abs(v)), l2=F.sqrt(F.sum(v * v)), linf=F.max(F.abs(v)), rmse=F.sqrt(F.avg(v * v)), nonzero=F.count_if(v != 0))
    return out.select("vec_id", *[rnd(c).alias(c) for c in ("total", "mean", "variance", "stddev", "l1", "l2", "linf", "rmse")], "nonzero")


@query("stats_exact_sum", "SELECT o_orderstatus, sum(o_totalprice::DECIMAL(26, 12))::DOUBLE AS total FROM orders GROUP BY 1")
def _(spark, sf):
    g = Grid(table(spark, sf, "orders").select("o_orderstatus", F.col("o_totalprice").alias("v")), (1,), ("o_orderstatus",))
    return stats.exact_total(g)


@query("stats_extremes", f"WITH {PX} SELECT vec_id, {R('min(v)')} AS least, arg_min(i0 * 8 + i1, (v, i0 * 8 + i1))::BIGINT AS least_at, {R('max(v)')} AS most, arg_min(i0 * 8 + i1, (-v, i0 * 8 + i1))::BIGINT AS most_at FROM px GROUP BY 1")
def _(spark, sf):
    return stats.extremes(images(spark, sf)).select("vec_id", rnd("least").alias("least"), "least_at", rnd("most").alias("most"), "most_at")


@query("stats_complex_extremes", f"WITH {CX} SELECT vec_id, {R('min(' + _M + ')')} AS least, {R('max(' + _M + ')')} AS most FROM cx GROUP BY 1")
def _(spark, sf):
    return stats.extremes(complex_images(spark, sf)).select("vec_id", rnd("least").alias("least"), rnd("most").alias("most"))


_D = "sqrt((a.re - b.re) * (a.re - b.re) + (a.im - b.im) * (a.im - b.im))"


@query("stats_distances", f"WITH {CX} SELECT a.vec_id, {R(f'sum({_D})')} AS l1, {R(f'sqrt(sum({_D} * {_D}))')} AS l2, {R(f'max({_D})')} AS linf FROM cx a JOIN (SELECT vec_id, 3 - i0 AS i0, i1, re, im FROM cx) b USING (vec_id, i0, i1) GROUP BY 1")
def _(spark, sf):
    g = complex_images(spark, sf)
    d = stats.difference(g, arrays.reverse_rows(g))
    out = stats.summary(d, l1=F.sum(stats.magnitude(d)), l2=F.sqrt(F.sum(stats.power(d))), linf=F.max(stats.magnitude(d)))
    return out.select("vec_id", *[rnd(c).alias(c) for c in ("l1", "l2", "linf")])


@query("stats_linear_fit", "SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return stats.linear_fit(t, ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", rnd("slope", 4).alias("slope"), rnd("intercept", 4).alias("intercept"))


@query("stats_covariance", f"WITH {PX} SELECT a.vec_id, {R('covar_samp(a.v, b.v)')} AS covariance FROM px a JOIN (SELECT vec_id, 7 - i0 AS i0, i1, v FROM px) b USING (vec_id, i0, i1) GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    return stats.covariance(g, arrays.reverse_rows(g)).select("vec_id", rnd("covariance").alias("covariance"))


@query("stats_centered_magnitude_average", f"WITH {CX} SELECT vec_id, {R(f'avg({_M})')} AS mean FROM cx WHERE i0 BETWEEN 1 AND 2 AND i1 BETWEEN 2 AND 5 GROUP BY 1")
def _(spark, sf):
    return stats.centered_magnitude_average(complex_images(spark, sf), 2, 4).select("vec_id", rnd("mean").alias("mean"))


_OTSU = f"""WITH {PX}, e AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1),
h AS (SELECT vec_id, lo, hi, floor((v - lo) * (255.0 / (hi - lo)))::INT AS bin, count(*) AS n FROM px JOIN e USING (vec_id) WHERE hi > lo GROUP BY 1, 2, 3, 4),
c AS (SELECT *, sum(n) OVER r AS w0, sum(n * bin) OVER r AS s0, sum(n) OVER a AS wn, sum(n * bin) OVER a AS sn FROM h WINDOW r AS (PARTITION BY vec_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY vec_id)),
b AS (SELECT vec_id, lo, hi, bin, w0::DOUBLE * (wn - w0) * (s0::DOUBLE / w0 - (sn - s0)::DOUBLE / (wn - w0)) * (s0::DOUBLE / w0 - (sn - s0)::DOUBLE / (wn - w0)) AS between_ FROM c WHERE wn > w0),
t AS (SELECT vec_id, lo + arg_min(bin, (-between_, bin)) / (255.0 / (hi - lo)) AS threshold FROM b GROUP BY vec_id, lo, hi)"""


@query("stats_otsu_threshold", f"{_OTSU} SELECT vec_id, {R('threshold')} AS threshold FROM t")
def _(spark, sf):
    return stats.otsu_threshold(images(spark, sf)).select("vec_id", rnd("threshold").alias("threshold"))


@query("image_otsu_mask", f"{_OTSU} SELECT vec_id, i0, i1, CASE WHEN v > threshold THEN 1.0 ELSE 0.0 END AS v FROM px JOIN t USING (vec_id)")
def _(spark, sf):
    return image.otsu_mask(images(spark, sf)).df


@query("inspect_percentile_window", "WITH r AS (SELECT l_returnflag AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), p AS (SELECT *, greatest(least(0.9 * n - 0.5, n - 1), 0) AS pos_ FROM r) SELECT k, round(max(v) FILTER (r = floor(pos_)) + (max(v) FILTER (r = least(floor(pos_) + 1, n - 1)) - max(v) FILTER (r = floor(pos_))) * max(pos_ - floor(pos_)), 4) + 0.0 AS p90 FROM p GROUP BY k")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v"))
    return stats.midpoint_percentile(t, ["k"], "v", 90.0, "p90").select("k", rnd("p90", 4).alias("p90"))


# ---------------------------------------------------------------- linear algebra
@query("linalg_matmul", f"WITH {PX} SELECT a.vec_id, a.i0, b.i1, {R('sum(a.v * b.v)')} AS v FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.i1 = b.i0 GROUP BY 1, 2, 3")
def _(spark, sf):
    g = images(spark, sf)
    return shown(linalg.matmul(g, g))


@query("linalg_gemv_dot", f"WITH {PX}, x AS (SELECT vec_id, i0 AS k, sum(v) AS s FROM px GROUP BY 1, 2), y AS (SELECT p.vec_id, p.i0, sum(p.v * s) AS y FROM px p JOIN x ON p.vec_id = x.vec_id AND p.i1 = x.k GROUP BY 1, 2) SELECT y.vec_id, {R('sum(y * s)')} AS v FROM y JOIN x ON y.vec_id = x.vec_id AND y.i0 = x.k GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    x = arrays.sum_axis(g, 1)
    return linalg.dot(linalg.gemv(g, x), x).select("vec_id", rnd("v").alias("v"))


@query("linalg_hermitian_gram", f"WITH {CX} SELECT a.vec_id, a.i1 AS i0, b.i1, {R('sum(a.re * b.re + a.im * b.im)')} AS re, {R('sum(a.re * b.im - a.im * b.re)')} AS im FROM cx a JOIN cx b ON a.vec_id = b.vec_id AND a.i0 = b.i0 GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(linalg.hermitian_gram(complex_images(spark, sf)))


@query("linalg_diagonal", f"WITH {PX} SELECT vec_id, {R('sum(abs(v + CASE WHEN i0 = i1 THEN 2 ELSE 0 END))')} AS total FROM px WHERE i0 = i1 GROUP BY 1")
def _(spark, sf):
    return linalg.diagonal_abs_sum(linalg.add_to_diagonal(images(spark, sf), 2.0)).select("vec_id", rnd("total").alias("total"))


@query("linalg_axpy", f"SELECT vec_id, (i // 8)::INT AS i0, (i % 8)::INT AS i1, {R('2.5 * embedding[i + 1]::DOUBLE + embedding[(i % 8) * 8 + i // 8 + 1]::DOUBLE')} AS v FROM embeddings, range(64) r(i)")
def _(spark, sf):
    g = images(spark, sf)
    return shown(linalg.axpy(2.5, g, arrays.transpose(g)))


@query("linalg_rotation", "SELECT c_custkey, round(0.8 * c_acctbal - 0.6 * c_nationkey, 4) + 0.0 AS x, round(0.6 * c_acctbal + 0.8 * c_nationkey, 4) + 0.0 AS y FROM customer")
def _(spark, sf):
    m = linalg.rotation("z", math.atan2(0.6, 0.8))
    x, y, _ = linalg.matrix_times_point(m, F.col("c_acctbal"), F.col("c_nationkey").cast("double"), F.lit(1.0))
    return table(spark, sf, "customer").select("c_custkey", rnd(x, 4).alias("x"), rnd(y, 4).alias("y"))


def _spd(g: Grid) -> Grid:
    return linalg.add_to_diagonal(linalg.hermitian_gram(g), 1.0)


@query("linalg_solve_residual", f"WITH {PX} SELECT vec_id, i0, 0.0 AS v FROM px WHERE i1 = 0")
def _(spark, sf):
    a = _spd(images(spark, sf))
    b = arrays.select_index(images(spark, sf), 1, 0)
    return shown(linalg.gemv(a, linalg.solve(a, b)).zip(b, lambda x, y: x - y))


@query("linalg_cholesky_rebuilt", f"WITH {PX}, g AS (SELECT a.vec_id, a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) + CASE WHEN a.i1 = b.i1 THEN 1 ELSE 0 END AS v FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.i0 = b.i0 GROUP BY 1, 2, 3) SELECT vec_id, i0, i1, {R('v')} AS v FROM g")
def _(spark, sf):
    low = linalg.cholesky_lower(_spd(images(spark, sf)))
    return shown(linalg.contract(low, low, 1, 1))


@query("linalg_inverse_product", f"WITH {PX} SELECT vec_id, i0, i1, CASE WHEN i0 = i1 THEN 1.0 ELSE 0.0 END AS v FROM px")
def _(spark, sf):
    a = _spd(images(spark, sf))
    return shown(linalg.matmul(a, linalg.inverse(a)))


@query("linalg_singular_values", f"WITH {PX} SELECT vec_id, {R('sum(v * v)')} AS power FROM px GROUP BY 1")
def _(spark, sf):
    s = linalg.singular_values(images(spark, sf))
    return s.df.groupBy("vec_id").agg(rnd(F.sum(F.col("v") * F.col("v"))).alias("power"))


@query("linalg_eigenvalue_trace", f"WITH {PX} SELECT vec_id, {R('sum(v * v) + 8')} AS trace FROM px GROUP BY 1")
def _(spark, sf):
    w = linalg.self_adjoint_eigenvalues(_spd(images(spark, sf)))
    return w.df.groupBy("vec_id").agg(rnd(F.sum("v")).alias("trace"))


@query("linalg_tall_least_squares", f"WITH {PX} SELECT DISTINCT i1 AS i0, 1.0 AS v FROM px")
def _(spark, sf):
    g = images(spark, sf)
    tall = Grid(g.df.select((F.col("vec_id") * 8 + F.col("i0")).cast("int").alias("i0"), "i1", "v"), (1 << 30, 8))
    return shown(linalg.tall_least_squares(tall, arrays.sum_axis(tall, 1)))


# ---------------------------------------------------------------- Fourier
_DFT = lambda sign, n0, n1: f"{sign * 2 * math.pi!r} * (({{a}} * f0) % {n0} / {n0}.0 + ({{b}} * f1) % {n1} / {n1}.0)".format(a="i0", b="i1")


@query("fft2_forward", f"WITH {CX} SELECT vec_id, f0::INT AS i0, f1::INT AS i1, {R(f'sum(re * cos({_DFT(-1, 4, 8)}) - im * sin({_DFT(-1, 4, 8)}))')} AS re, {R(f'sum(re * sin({_DFT(-1, 4, 8)}) + im * cos({_DFT(-1, 4, 8)}))')} AS im FROM cx, range(4) a(f0), range(8) b(f1) GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(fft.fft2(complex_images(spark, sf)))


@query("fft2_inverse_by_sums", f"WITH {CX} SELECT vec_id, f0::INT AS i0, f1::INT AS i1, {R(f'sum(re * cos({_DFT(1, 4, 8)}) - im * sin({_DFT(1, 4, 8)})) / 32')} AS re, {R(f'sum(re * sin({_DFT(1, 4, 8)}) + im * cos({_DFT(1, 4, 8)})) / 32')} AS im FROM cx, range(4) a(f0), range(8) b(f1) GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(fft.dft2(complex_images(spark, sf), True))


@query("fft_round_trip", f"WITH {CX} SELECT vec_id, i0, i1, {R('re')} AS re, {R('im')} AS im FROM cx")
def _(spark, sf):
    return shown(fft.ifft(fft.fft(complex_images(spark, sf), "orthonormal"), "orthonormal"))


@query("fft_segmented", f"WITH {PX} SELECT vec_id, ((i // 8) * 8 + f)::INT AS i0, {R(f'sum(v * cos(-{2 * math.pi!r} * ((i % 8) * f % 8) / 8.0))')} AS re, {R(f'sum(v * sin(-{2 * math.pi!r} * ((i % 8) * f % 8) / 8.0))')} AS im FROM (SELECT vec_id, i0 * 8 + i1 AS i, v FROM px), range(8) r(f) GROUP BY 1, 2")
def _(spark, sf):
    return shown(fft.fft_segmented(arrays.ravel(images(spark, sf)), 8))


@query("fft_convolve2d_same", f"WITH {PX}, k AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, 2.0), (0, 2, 0.5), (1, 0, -1.0), (1, 1, 3.0), (1, 2, 1.0), (2, 0, 0.0), (2, 1, 1.0), (2, 2, 2.0)) t(a, b, w)) SELECT vec_id, (i0 + a - 1)::INT AS i0, (i1 + b - 1)::INT AS i1, {R('sum(v * w)')} AS v FROM px, k WHERE i0 + a - 1 BETWEEN 0 AND 7 AND i1 + b - 1 BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(fft.convolve2d_fft(images(spark, sf), np.array([[1.0, 2.0, 0.5], [-1.0, 3.0, 1.0], [0.0, 1.0, 2.0]]), "same"))


# ---------------------------------------------------------------- images
def _near(agg: str, offs: list[tuple[int, int, float]], border: str = "replicate", digits: int = 6, extra: str = "") -> str:
    rows = ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in offs)
    at = {"replicate": "least(greatest({x}, 0), 7)", "reflect101": "CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 7 THEN 14 - ({x}) ELSE {x} END", "reflect": "CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} > 7 THEN 15 - ({x}) ELSE {x} END", "constant": "{x}"}[border]
    kind = "LEFT JOIN" if border == "constant" else "JOIN"
    return f"WITH {PX}, k AS (SELECT * FROM (VALUES {rows}) t(a, b, w)), n AS (SELECT p.vec_id, p.i0, p.i1, p.v AS mid, k.w, coalesce(q.v, 0) AS v FROM px p CROSS JOIN k {kind} px q ON q.vec_id = p.vec_id AND q.i0 = {at.format(x='p.i0 + k.a')} AND q.i1 = {at.format(x='p.i1 + k.b')}) SELECT vec_id, i0, i1, {R(agg, digits)} AS v FROM n{extra} GROUP BY vec_id, i0, i1"


def imagewise(name: str, f: Callable[[Grid], Grid], sql: str, digits: int = 6) -> None:
    @query(f"image_{name}", sql)
    def run(spark, sf):
        return shown(f(images(spark, sf)), digits)


_K3 = [[0.5, 1.0, -1.0], [2.0, 0.25, 0.0], [1.0, -2.0, 1.5]]
_W3 = image.kernel_weights(_K3)
_BIL = [(a, b, math.exp(-(a * a + b * b) / 2)) for a in range(-1, 2) for b in range(-1, 2) if a * a + b * b <= 1]
imagewise("filter2d_replicate", lambda g: image.filter2d(g, _K3), _near("sum(w * v)", _W3))
imagewise("filter2d_reflect101", lambda g: image.filter2d(g, _K3, "reflect101"), _near("sum(w * v)", _W3, "reflect101"))
imagewise("filter2d_reflect", lambda g: image.filter2d(g, _K3, "reflect"), _near("sum(w * v)", _W3, "reflect"))
imagewise("filter2d_constant", lambda g: image.filter2d(g, _K3, "constant"), _near("sum(w * v)", _W3, "constant"))
imagewise("box_filter", lambda g: image.box_filter(g, 4, 3), _near("sum(w * v)", image.kernel_weights(np.full((4, 3), 1 / 12))))
imagewise("gaussian_blur", lambda g: image.gaussian_blur(g, 3, 0.8), _near("sum(w * v)", image.kernel_weights(np.outer(image.gaussian_kernel(3, 0.8), image.gaussian_kernel(3, 0.8)))))
imagewise("bilateral_filter", lambda g: image.bilateral_filter(g, 3, 0.2, 1.0), _near("sum(w * exp(-(v - mid) * (v - mid) / 0.08) * v) / sum(w * exp(-(v - mid) * (v - mid) / 0.08))", _BIL))
imagewise("median_filter", lambda g: image.median_filter(g, 3), _near("median(v)", image.box(3, 3)))
imagewise("median3x3_interior_zero", image.median3x3_interior_zero, _near("CASE WHEN i0 BETWEEN 1 AND 6 AND i1 BETWEEN 1 AND 6 THEN median(v) ELSE 0 END", image.box(3, 3)))
imagewise("phase_quality_map", image.phase_quality_map3x3, _near("CASE WHEN i0 BETWEEN 1 AND 6 AND i1 BETWEEN 1 AND 6 THEN CASE WHEN sqrt(sum(cos(v)) * sum(cos(v)) + sum(sin(v)) * sum(sin(v))) / 81 < 0.07 THEN 0 ELSE 1 END ELSE 0 END", image.box(3, 3)))
imagewise("sobel_x", image.sobel_x, _near("sum(w * v)", image.kernel_weights(image.SOBEL_X)))
imagewise("sobel_y", image.sobel_y, _near("sum(w * v)", image.kernel_weights(np.array(image.SOBEL_X).T)))
imagewise("gradient_magnitude", image.gradient_magnitude, f"WITH x AS ({_near('sum(w * v)', image.kernel_weights(image.SOBEL_X), digits=12)}), y AS ({_near('sum(w * v)', image.kernel_weights(np.array(image.SOBEL_X).T), digits=12)}) SELECT vec_id, i0, i1, {R('sqrt(x.v * x.v + y.v * y.v)')} AS v FROM x JOIN y USING (vec_id, i0, i1)")
imagewise("laplacian", image.laplacian, _near("sum(w * v)", image.kernel_weights(image.LAPLACIAN)))
imagewise("unsharp_mask", lambda g: image.unsharp_mask(g, 1.5, 3, 0.8), _near("max(mid) + 1.5 * (max(mid) - sum(w * v))", image.kernel_weights(np.outer(image.gaussian_kernel(3, 0.8), image.gaussian_kernel(3, 0.8)))))
imagewise("dilate_box", lambda g: image.dilate(g, image.box(3, 5)), _near("max(v)", image.box(3, 5)))
imagewise("erode_ellipse", lambda g: image.erode(g, image.ellipse(5, 3)), _near("min(v)", image.ellipse(5, 3)))
imagewise("dilate_mask_disk", lambda g: image.dilate_mask(g.map(lambda v: F.when(v > 0.15, 1.0).otherwise(0.0)), image.disk_structuring_element(2)), _near("max(CASE WHEN v > 0.15 THEN 1.0 ELSE 0.0 END)", image.disk_structuring_element(2), "constant"))
def _crossed(own: str, near: str, value: str) -> str:
    return f"WITH {PX} SELECT p.vec_id, p.i0, p.i1, {R(f'CASE WHEN p.i0 BETWEEN 1 AND 6 AND p.i1 BETWEEN 1 AND 6 AND {own} AND bool_or({near}) THEN {value} ELSE p.v END')} AS v FROM px p CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) k(a, b) LEFT JOIN px q ON q.vec_id = p.vec_id AND q.i0 = p.i0 + a AND q.i1 = p.i1 + b GROUP BY p.vec_id, p.i0, p.i1, p.v"


imagewise("erode_threshold_cross", lambda g: image.erode_threshold_cross(g, 0.0, -0.1, -9.0), _crossed("p.v > 0", "q.v < -0.1", "-9"))
imagewise("dilate_threshold_cross", lambda g: image.dilate_threshold_cross(g, 0.0, 0.1, 9.0), _crossed("p.v < 0", "q.v > 0.1", "9"))
imagewise("dilate_cross_value", lambda g: image.dilate_cross_value(g.map(lambda v: F.when(v > 0.1, 1.0).otherwise(0.0)), 1.0), _crossed("p.v <> 1", "q.v = 1", "1").replace(PX, PX.replace("embedding[i + 1]::DOUBLE AS v", "CASE WHEN embedding[i + 1]::DOUBLE > 0.1 THEN 1.0 ELSE 0.0 END AS v")))
imagewise("erode_cross_value", lambda g: image.erode_cross_value(g.map(lambda v: F.when(v > -0.1, 1.0).otherwise(0.0)), 1.0, -1.0), _crossed("p.v = 1", "q.v <> 1", "-1").replace(PX, PX.replace("embedding[i + 1]::DOUBLE AS v", "CASE WHEN embedding[i + 1]::DOUBLE > -0.1 THEN 1.0 ELSE 0.0 END AS v")))
imagewise("normalize_minmax", image.normalize_minmax, f"WITH {PX} SELECT vec_id, i0, i1, {R('(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)')} AS v FROM px WINDOW w AS (PARTITION BY vec_id)")
imagewise("pad_reflect", lambda g: image.pad(g, 1, 2, 3, 1, "reflect"), f"WITH {PX} SELECT k.vec_id, r::INT AS i0, c::INT AS i1, {R('v')} AS v FROM (SELECT DISTINCT vec_id FROM px) k CROSS JOIN range(11) a(r) CROSS JOIN range(12) b(c) JOIN px p ON p.vec_id = k.vec_id AND p.i0 = CASE WHEN r - 1 < 0 THEN -1 - (r - 1) WHEN r - 1 > 7 THEN 15 - (r - 1) ELSE r - 1 END AND p.i1 = CASE WHEN c - 3 < 0 THEN -1 - (c - 3) WHEN c - 3 > 7 THEN 15 - (c - 3) ELSE c - 3 END")
imagewise("center_crop", lambda g: image.center_crop(g, 4, 6), f"WITH {PX} SELECT vec_id, i0 - 2 AS i0, i1 - 1 AS i1, {R('v')} AS v FROM px WHERE i0 BETWEEN 2 AND 5 AND i1 BETWEEN 1 AND 6")
imagewise("center_pad_or_crop", lambda g: image.center_pad_or_crop(g, 4, 10), f"WITH {PX} SELECT k.vec_id, r::INT AS i0, c::INT AS i1, {R('coalesce(v, 0)')} AS v FROM (SELECT DISTINCT vec_id FROM px) k CROSS JOIN range(4) a(r) CROSS JOIN range(10) b(c) LEFT JOIN px p ON p.vec_id = k.vec_id AND p.i0 = r + 2 AND p.i1 = c - 1")
imagewise("copy_roi", lambda g: image.copy_roi(g, arrays.crop(g, (0, 0), (2, 2)), 5, 6), f"SELECT vec_id, (i // 8)::INT AS i0, (i % 8)::INT AS i1, {R('CASE WHEN i // 8 BETWEEN 5 AND 6 AND i % 8 BETWEEN 6 AND 7 THEN embedding[(i // 8 - 5) * 8 + i % 8 - 6 + 1]::DOUBLE ELSE embedding[i + 1]::DOUBLE END')} AS v FROM embeddings, range(64) r(i)")


def _resized(kind: str, rows: int, cols: int) -> str:
    tap = lambda n, m: ", ".join(f"({o}, {i}, {w!r}::DOUBLE)" for o, i, w in image.taps(n, m, kind))
    return f"WITH {PX}, a AS (SELECT * FROM (VALUES {tap(8, rows)}) t(o, i, w)), b AS (SELECT * FROM (VALUES {tap(8, cols)}) t(o, i, w)) SELECT vec_id, a.o AS i0, b.o AS i1, {R('sum(a.w * b.w * v)')} AS v FROM px JOIN a ON i0 = a.i JOIN b ON i1 = b.i GROUP BY 1, 2, 3"


for _k in ("nearest", "linear", "cubic", "area", "lanczos4"):
    imagewise(f"resize_{_k}", lambda g, k=_k: image.resize(g, 5, 11, k), _resized(_k, 5, 11))


def _reached(start: str, can: str, steps: str) -> str:
    """Pixels reached from a start over 4-neighbours, by a recursive query."""
    return f"WITH RECURSIVE {PX}, r AS (SELECT vec_id, i0, i1 FROM px WHERE {start} UNION SELECT p.vec_id, p.i0, p.i1 FROM r JOIN px p ON p.vec_id = r.vec_id AND abs(p.i0 - r.i0) + abs(p.i1 - r.i1) = 1 WHERE {can}) {steps}"


imagewise("region_grow", lambda g: image.region_grow(g, (3, 3), -0.1, 0.2), _reached("i0 = 3 AND i1 = 3 AND v BETWEEN -0.1 AND 0.2", "p.v BETWEEN -0.1 AND 0.2", "SELECT px.vec_id, px.i0, px.i1, CASE WHEN r.i0 IS NULL THEN 0.0 ELSE 1.0 END AS v FROM px LEFT JOIN r USING (vec_id, i0, i1)"))
imagewise("fill_holes", lambda g: image.fill_holes(g.map(lambda v: F.when(v > 0.0, 1.0).otherwise(0.0))), _reached("v <= 0 AND (i0 IN (0, 7) OR i1 IN (0, 7))", "p.v <= 0", "SELECT px.vec_id, px.i0, px.i1, CASE WHEN r.i0 IS NULL THEN 1.0 ELSE 0.0 END AS v FROM px LEFT JOIN r USING (vec_id, i0, i1)"))


@query("image_connected_components", f"WITH RECURSIVE {PX}, m AS (SELECT vec_id, i0, i1 FROM px WHERE v > 0.05), r AS (SELECT vec_id, i0, i1, i0 * 8 + i1 AS root FROM m UNION SELECT p.vec_id, p.i0, p.i1, r.root FROM r JOIN m p ON p.vec_id = r.vec_id AND abs(p.i0 - r.i0) + abs(p.i1 - r.i1) = 1 WHERE r.root < p.i0 * 8 + p.i1), l AS (SELECT vec_id, i0, i1, min(root) AS root FROM r GROUP BY 1, 2, 3), c AS (SELECT vec_id, i0, i1, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS label FROM l) SELECT vec_id, label::INT AS label, count(*) AS area, min(i0) AS top, max(i0) AS bottom, min(i1) AS \"left\", max(i1) AS \"right\", {R('avg(i0)')} AS \"row\", {R('avg(i1)')} AS col FROM c GROUP BY 1, 2")
def _(spark, sf):
    lab = image.connected_components(images(spark, sf).map(lambda v: F.when(v > 0.05, 1.0).otherwise(0.0)))
    return image.component_stats(lab).select("vec_id", "label", "area", "top", "bottom", "left", "right", rnd("row").alias("row"), rnd("col").alias("col"))


@query("image_distance_transform", f"WITH {PX} SELECT p.vec_id, p.i0, p.i1, {R('min(sqrt((p.i0 - q.i0) ** 2 + (p.i1 - q.i1) ** 2))')} AS v FROM px p JOIN px q ON p.vec_id = q.vec_id AND q.v <= 0.05 GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(image.distance_transform_l2(images(spark, sf).map(lambda v: F.when(v > 0.05, 1.0).otherwise(0.0))))



# ---------------------------------------------------------------- signals
@query("signal_fir_filter", f"WITH {SIG}, t AS (SELECT * FROM (VALUES (0, 0.5), (1, 0.3), (2, 0.2)) t(k, w)) SELECT user_id, (i0 + k)::INT AS i0, {R('sum(v * w)')} AS v FROM sig JOIN t ON true GROUP BY 1, 2")
def _(spark, sf):
    g = Grid(signals(spark, sf), (1,), ("user_id",))
    return shown(signal.convolve(g, [0.5, 0.3, 0.2]))


@query("signal_causal_median", f"WITH {SIG} SELECT user_id, i0, {R('median(v) OVER (PARTITION BY user_id ORDER BY i0 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS v FROM sig")
def _(spark, sf):
    return signal.causal_median(signals(spark, sf), ["user_id"], ["i0"], "v", 5).select("user_id", "i0", rnd("v").alias("v"))


@query("signal_unwrap_phase", f"WITH {SIG}, p AS (SELECT user_id, i0, (v % 6.0) - 3.0 AS v FROM sig), d AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY i0) AS s FROM p) SELECT user_id, i0, {R(f'v + {2 * math.pi!r} * sum(CASE WHEN s > 2.0 THEN -1 WHEN s < -2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i0 ROWS UNBOUNDED PRECEDING)')} AS v FROM d")
def _(spark, sf):
    df = signals(spark, sf).withColumn("v", F.col("v") % 6.0 - 3.0)
    return signal.unwrapped(df, ["user_id"], ["i0"], "v", 2.0).select("user_id", "i0", rnd("v").alias("v"))


@query("signal_iir_filter", f"WITH RECURSIVE {PX}, s AS (SELECT vec_id, i0 * 8 + i1 AS i, v FROM px), y AS (SELECT vec_id, i, v, 0.5 * v AS y FROM s WHERE i = 0 UNION ALL SELECT s.vec_id, s.i, s.v, 0.5 * s.v + 0.25 * y.v + 0.3 * y.y FROM y JOIN s ON s.vec_id = y.vec_id AND s.i = y.i + 1) SELECT vec_id, i::INT AS i0, {R('y')} AS v FROM y")
def _(spark, sf):
    return shown(signal.iir_filter(arrays.ravel(images(spark, sf)), [0.5, 0.25], [1.0, -0.3]))


@query("signal_median_filter", f"WITH {PX}, s AS (SELECT vec_id, i0 * 8 + i1 AS i, v FROM px) SELECT a.vec_id, a.i::INT AS i0, {R('median(coalesce(b.v, 0))')} AS v FROM s a CROSS JOIN range(-2, 3) r(o) LEFT JOIN s b ON b.vec_id = a.vec_id AND b.i = a.i + o GROUP BY 1, 2")
def _(spark, sf):
    return shown(signal.median_filter(arrays.ravel(images(spark, sf)), 5, "zero"))


@query("signal_convolve2d_full", f"WITH {PX}, k AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, 2.0), (1, 0, -1.0), (1, 1, 0.5)) t(a, b, w)) SELECT vec_id, (i0 + a)::INT AS i0, (i1 + b)::INT AS i1, {R('sum(v * w)')} AS v FROM px JOIN k ON true GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(signal.convolve2d_full(images(spark, sf), [[1.0, 2.0], [-1.0, 0.5]]))


@query("signal_unwrap_phase_2d", f"WITH {PX}, p AS (SELECT vec_id, i0, i1, v * 20 AS v FROM px), a AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id, i0 ORDER BY i1) AS s FROM p), b AS (SELECT vec_id, i0, i1, v + {2 * math.pi!r} * sum(CASE WHEN s > {math.pi!r} THEN -1 WHEN s < -{math.pi!r} THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id, i0 ORDER BY i1 ROWS UNBOUNDED PRECEDING) AS v FROM a), c AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id, i1 ORDER BY i0) AS s FROM b) SELECT vec_id, i0, i1, {R(f'v + {2 * math.pi!r} * sum(CASE WHEN s > {math.pi!r} THEN -1 WHEN s < -{math.pi!r} THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id, i1 ORDER BY i0 ROWS UNBOUNDED PRECEDING)')} AS v FROM c")
def _(spark, sf):
    return shown(signal.unwrap_phase_2d(images(spark, sf).map(lambda v: v * 20.0)))


@query("signal_resample_cubic", f"WITH {PX}, s AS (SELECT vec_id, i0 * 8 + i1 AS i, v FROM px), t AS (SELECT * FROM (VALUES {', '.join(f'({o}, {i}, {w!r}::DOUBLE)' for o, i, w in image.taps(64, 40, 'cubic'))}) t(o, i, w)) SELECT vec_id, o AS i0, {R('sum(w * v)')} AS v FROM s JOIN t USING (i) GROUP BY 1, 2")
def _(spark, sf):
    return shown(signal.resample(arrays.ravel(images(spark, sf)), 40, "cubic"))


def curvewise(name: str, f, sql: str, n: int = 64) -> None:
    @query(f"window_{name}", f"SELECT i::INT AS i0, {R(sql, 9)} AS v FROM range({n}) r(i)")
    def run(spark, sf):
        return shown(signal.curve(spark, n, f), 9)


_P = repr(math.pi)
CURVES = {
    "hann": (lambda i: win.window(i, 64, "hann"), f"0.5 - 0.5 * cos(2 * {_P} * i / 63)"), "hamming": (lambda i: win.window(i, 64, "hamming"), f"0.54 - 0.46 * cos(2 * {_P} * i / 63)"),
    "blackman": (lambda i: win.window(i, 64, "blackman"), f"0.42 - 0.5 * cos(2 * {_P} * i / 63) + 0.08 * cos(4 * {_P} * i / 63)"), "half_hann": (lambda i: win.half_hann_filter(i, 64), f"0.5 - 0.5 * cos({_P} * i / 63)"),
    "half_hamming": (lambda i: win.half_hamming_filter(i, 64), f"0.54 - 0.46 * cos({_P} * i / 63)"), "half_blackman": (lambda i: win.half_blackman_filter(i, 64), f"0.42 - 0.5 * cos({_P} * i / 63) + 0.08 * cos(2 * {_P} * i / 63)"),
    "hamming_bandpass": (lambda i: win.hamming_bandpass_filter(i, 64), f"0.54 - 0.46 * cos(2 * {_P} * i / 63)"), "dual_hamming_bandpass": (lambda i: win.dual_hamming_bandpass_filter(i, 64), f"0.54 - 0.46 * cos(2 * {_P} * CASE WHEN i < 32 THEN i ELSE i - 32 END / 31)"),
    "triangle": (lambda i: win.triangle_filter(i, 64), "(32 - i) * 2.0 / 63"), "hbrr": (lambda i: win.hbrr_filter(i, 64), f"sin({_P} * i / 63) * (2 - sin({_P} * i / 63))"),
    "tukey": (lambda i: win.tukey_window(i, 64, 0.4), f"CASE WHEN i < 12.6 THEN 0.5 * (1 + cos({_P} * (2 * i / 25.2 - 1))) WHEN i <= 63 - 12.6 THEN 1 ELSE 0.5 * (1 + cos({_P} * (2 * i / 25.2 - 5 + 1))) END"),
    "exponential": (lambda i: win.exponential_window(i, 64, 4.0), "exp(-4 * pow(abs((i - 31.5) / 63), 2))"), "exponential_filter": (lambda i: win.exponential_filter(i, 64, 4.0, 2.0), "exp(-4 * pow((i - 32) / 64.0, 2))"),
    "fermi": (lambda i: win.fermi_window(i, 64, 20.0, 2.0), "1 / (1 + exp((abs(i - 31.5) - 20) / 2))"), "fermi_filter": (lambda i: win.fermi_filter(i, 64, 20.0, 2.0), "1 / (1 + exp((abs(i - 32) - 20) / 2.0))"),
    "fermi_bandpass": (lambda i: win.fermi_bandpass_window(i, 64, 5.0, 20.0, 2.0), "1 / (1 + exp((5 - abs(i - 31.5)) / 2)) / (1 + exp((abs(i - 31.5) - 20) / 2))"),
    "dual_fermi_band": (lambda i: win.dual_fermi_band_window(i, 64, 10.0, 4.0, 1.0), "greatest(1 / (1 + exp(abs(i - 21.5) - 4)), 1 / (1 + exp(abs(i - 41.5) - 4)))"),
    "quadratic_exponential": (lambda i: win.quadratic_exponential_window(i, 64, 0.5, -2.0), "exp((i - 32) * (i - 32) * -2.0 / (32.0 * 32.0))"), "t2_linear": (lambda i: win.t2_linear_filter(i, 3, 0.5, 10), "(3 + i - 10) * 0.5 + 1"),
    "t2_exponential": (lambda i: win.t2_exponential_filter(i, 3, 0.5, 10, 20.0), "exp((10 - (3 + i)) * 0.5 / 20)"), "rectangular": (lambda i: win.window(i, 64, "rectangular"), "1.0"),
    "tukey_filter": (lambda i: win.tukey_filter(i, 0.4, 64), f"CASE WHEN i < 13 THEN 0.5 * (1 + cos({_P} / 0.2 * (i / 63.0 - 0.2))) WHEN i >= 52 THEN 0.5 * (1 + cos({_P} / 0.2 * (i / 63.0 - 1 + 0.2))) ELSE 1 END"),
}
for _n, (_f, _s) in CURVES.items():
    curvewise(_n, _f, _s)


# ---------------------------------------------------------------- sparse
def _coo(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("v"))


@query("sparse_spmv", "SELECT l_orderkey AS \"row\", round(sum(l_quantity * p_retailprice), 3) + 0.0 AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    return sparse.spmv(_coo(spark, sf), x).select("row", rnd("y", 3).alias("y"))


@query("sparse_spmv_transposed", "SELECT l_partkey AS \"row\", round(sum(l_quantity * o_totalprice), 2) + 0.0 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"))
    return sparse.spmv(_coo(spark, sf), x, "transpose").select("row", rnd("y", 2).alias("y"))


@query("sparse_add", "SELECT k AS \"row\", p AS col, sum(v) AS v FROM (SELECT l_orderkey AS k, l_partkey AS p, 2 * l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem) GROUP BY 1, 2")
def _(spark, sf):
    other = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("v"))
    return sparse.add(_coo(spark, sf), 2.0, other)


@query("sparse_spmm", "SELECT l_orderkey AS \"row\", p_size::BIGINT AS col, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def _(spark, sf):
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").cast("long").alias("col"), F.lit(1.0).alias("v"))
    return sparse.spmm(_coo(spark, sf), b)


@query("sparse_triangular_solve", f"WITH {PX} SELECT vec_id, 0 AS j, i0 AS \"row\", 0.0 AS residual FROM px WHERE i1 = 0")
def _(spark, sf):
    g = linalg.add_to_diagonal(images(spark, sf), 2.0)
    low = g.df.where("i1 <= i0").select("vec_id", F.col("i0").alias("row"), F.col("i1").alias("col"), "v")
    b = images(spark, sf).df.where("i1 = 0").select("vec_id", F.lit(0).alias("j"), F.col("i0").alias("row"), "v")
    x = sparse.triangular_solve(low, b, ["vec_id"])
    back = low.join(x.select("vec_id", "j", F.col("row").alias("col"), "x"), ["vec_id", "col"]).groupBy("vec_id", "j", "row").agg(F.sum(F.col("v") * F.col("x")).alias("b"))
    return back.join(b, ["vec_id", "j", "row"]).select("vec_id", "j", "row", rnd(F.col("b") - F.col("v")).alias("residual"))


# ---------------------------------------------------------------- non-uniform Fourier
def _trajectory(spark, n: int = 6) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("sample"), (F.col("id") * 0.4 - 1.0).alias("k_row"), (F.col("id") * -0.3 + 0.7).alias("k_col"))


_ANG = "((s * 0.4 - 1.0) * (i0 - 1.5) + (s * -0.3 + 0.7) * (i1 - 3.5))"


@query("nufft_direct_forward", f"WITH {CX} SELECT vec_id, s::INT AS sample, {R(f'sum(re * cos({_ANG}) + im * sin({_ANG}))')} AS re, {R(f'sum(im * cos({_ANG}) - re * sin({_ANG}))')} AS im FROM cx, range(6) r(s) GROUP BY 1, 2")
def _(spark, sf):
    return nufft.forward(complex_images(spark, sf), _trajectory(spark)).select("vec_id", "sample", rnd("re").alias("re"), rnd("im").alias("im"))


@query("nufft_direct_adjoint", f"WITH d AS (SELECT vec_id, s, embedding[s + 1]::DOUBLE AS re, embedding[s + 33]::DOUBLE AS im FROM embeddings, range(32) r(s)) SELECT vec_id, i0::INT AS i0, i1::INT AS i1, {R(f'sum(re * cos({_ANG}) - im * sin({_ANG}))')} AS re, {R(f'sum(re * sin({_ANG}) + im * cos({_ANG}))')} AS im FROM d, range(4) a(i0), range(8) b(i1) GROUP BY 1, 2, 3")
def _(spark, sf):
    s = complex_images(spark, sf, (32,)).df.withColumnRenamed("i0", "sample").join(_trajectory(spark, 32), "sample")
    return shown(nufft.adjoint(s, ("vec_id",), 4, 8))


@query("nufft_linear_gridding", f"WITH d AS (SELECT vec_id, s, s * 0.4 - 1.0 AS kr, s * -0.3 + 0.7 AS kc, embedding[s + 1]::DOUBLE AS re, embedding[s + 33]::DOUBLE AS im FROM embeddings, range(32) r(s)), p AS (SELECT *, kr * 4 / {2 * math.pi!r} AS pr, kc * 8 / {2 * math.pi!r} AS pc, -(kr * 1.5 + kc * 3.5) AS t FROM d), q AS (SELECT vec_id, ((floor(pr) + a) % 4 + 4)::INT % 4 AS i0, ((floor(pc) + b) % 8 + 8)::INT % 8 AS i1, CASE WHEN a = 1 THEN pr - floor(pr) ELSE 1 - (pr - floor(pr)) END * CASE WHEN b = 1 THEN pc - floor(pc) ELSE 1 - (pc - floor(pc)) END AS w, re * cos(t) - im * sin(t) AS zr, re * sin(t) + im * cos(t) AS zi FROM p, range(2) x(a), range(2) y(b)) SELECT vec_id, i0, i1, {R('sum(w * zr)')} AS re, {R('sum(w * zi)')} AS im FROM q GROUP BY 1, 2, 3")
def _(spark, sf):
    s = complex_images(spark, sf, (32,)).df.withColumnRenamed("i0", "sample").join(_trajectory(spark, 32), "sample")
    return shown(nufft.linear_gridding(s, ("vec_id",), 4, 8))


@query("nufft_normalized_trajectory", f"SELECT o_orderkey, round((o_custkey % 9 - 4) / 9.0 * {2 * math.pi!r}, 9) + 0.0 AS k_row, round((o_orderkey % 7 - 3) / 7.0 * {2 * math.pi!r}, 9) + 0.0 AS k_col FROM orders")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") % 7 - 3) / 7.0).alias("kx"), ((F.col("o_custkey") % 9 - 4) / 9.0).alias("ky"))
    return nufft.normalized_trajectory(t, "cycles_per_fov", 8, 8).select("o_orderkey", rnd("k_row", 9).alias("k_row"), rnd("k_col", 9).alias("k_col"))


# ---------------------------------------------------------------- reconstruction
def _kspace(spark, sf) -> Grid:
    """Each label is a frame of all its channels; channels differ by label, so shapes are those of one channel."""
    df = coils(spark, sf).select("label", F.col("channel").alias("i0"), F.col("i0").alias("i1"), F.col("i1").alias("i2"), "re", "im")
    return Grid(df, (1 << 16, 4, 8), ("label",), True)


@query("recon_coil_combine_rss", f"WITH {CX} SELECT label, i0, i1, {R('sqrt(sum(re * re + im * im))')} AS v FROM cx GROUP BY 1, 2, 3")
def _(spark, sf):
    df = coils(spark, sf)
    g = Grid(df.select("label", "i0", "i1", F.col("channel").alias("i2"), "re", "im"), (4, 8, 1 << 16), ("label",), True)
    return shown(recon.coil_combine_rss(g))


@query("recon_cartesian_rss", f"WITH {CX}, t AS (SELECT vec_id, label, f0::INT AS i0, f1::INT AS i1, sum(re * cos({_DFT(1, 4, 8)}) - im * sin({_DFT(1, 4, 8)})) / 32 AS re, sum(re * sin({_DFT(1, 4, 8)}) + im * cos({_DFT(1, 4, 8)})) / 32 AS im FROM cx, range(4) a(f0), range(8) b(f1) GROUP BY 1, 2, 3, 4) SELECT label, i0, i1, {R('sqrt(sum(re * re + im * im))')} AS v FROM t GROUP BY 1, 2, 3")
def recon_cartesian_rss(spark, sf):
    """The flagship: k-space of each frame through the pipeline document of the Cartesian route."""
    return shown(pipeline.run(pipeline.parse(pipeline.cartesian_rss()), {"kspace": _kspace(spark, sf)})["image"])


@query("recon_phase_correct", f"WITH {CX}, {CH}, k AS (SELECT * FROM cx JOIN ch USING (vec_id)), s AS (SELECT label, channel, i1, sum(re) AS a, sum(im) AS b FROM k GROUP BY 1, 2, 3), p AS (SELECT label, channel, i1, CASE WHEN a = 0 AND b = 0 THEN 1 ELSE a / sqrt(a * a + b * b) END AS c, CASE WHEN a = 0 AND b = 0 THEN 0 ELSE -b / sqrt(a * a + b * b) END AS d FROM s) SELECT k.label, k.channel AS i0, k.i0 AS i1, k.i1 AS i2, {R('re * c - im * d')} AS re, {R('re * d + im * c')} AS im FROM k JOIN p ON k.label = p.label AND k.channel = p.channel AND k.i1 = p.i1")
def _(spark, sf):
    k = _kspace(spark, sf)
    return shown(recon.phase_correct(k, recon.phase_correction_estimate(k)))


@query("recon_noise_covariance", f"WITH {CX}, c AS (SELECT vec_id, i0 AS ch, i1 AS s, re - avg(re) OVER w AS re, im - avg(im) OVER w AS im FROM cx WINDOW w AS (PARTITION BY vec_id, i0)) SELECT a.vec_id, a.ch AS i0, b.ch AS i1, {R('sum(a.re * b.re + a.im * b.im) / 8')} AS re, {R('sum(a.re * b.im - a.im * b.re) / 8')} AS im FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.s = b.s GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(recon.channel_covariance(complex_images(spark, sf)))


@query("recon_whitened_covariance", f"WITH {CX} SELECT vec_id, i0, i1, CASE WHEN i0 = i1 THEN 1.0 ELSE 0.0 END AS re, 0.0 AS im FROM cx WHERE i1 < 4")
def _(spark, sf):
    """W C W^H of each frame's own noise is the identity."""
    noise = complex_images(spark, sf)
    c = recon.channel_covariance(noise)
    w = recon.noise_model_estimate(noise)
    return shown(linalg.contract(linalg.matmul(w, c), w.map(cplx.conjugate), 1, 1), 4)


@query("recon_compressed_energy", f"WITH {CX} SELECT vec_id, {R('sum(re * re + im * im)', 5)} AS energy FROM cx GROUP BY 1")
def _(spark, sf):
    """All virtual channels together keep the energy of the physical ones."""
    k = complex_images(spark, sf, (4, 2, 4))
    y = recon.coil_compress(k, recon.coil_compression_basis_estimate(k, 4))
    return y.df.groupBy("vec_id").agg(rnd(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 5).alias("energy"))


@query("recon_readout_crop", f"WITH {CX}, {CH} SELECT label, channel AS i0, i0 AS i1, i1 - 2 AS i2, {R('re')} AS re, {R('im')} AS im FROM cx JOIN ch USING (vec_id) WHERE i1 BETWEEN 2 AND 5")
def _(spark, sf):
    return shown(recon.readout_oversampling_remove(_kspace(spark, sf), 2, 4))


@query("recon_noncartesian_adjoint", f"WITH d AS (SELECT vec_id, c, s, embedding[c * 16 + s + 1]::DOUBLE AS re, embedding[c * 16 + s + 33]::DOUBLE AS im FROM embeddings, range(2) x(c), range(16) r(s)) SELECT vec_id, i0::INT AS i0, i1::INT AS i1, c::INT AS i2, {R(f'sum(re * cos({_ANG}) - im * sin({_ANG}))')} AS re, {R(f'sum(re * sin({_ANG}) + im * cos({_ANG}))')} AS im FROM d, range(4) a(i0), range(8) b(i1) GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    k = complex_images(spark, sf, (2, 16))
    return shown(recon.noncartesian_adjoint_reconstruct(k, _trajectory(spark, 16), 4, 8))


@query("recon_sensitivity_combined", f"WITH {CX} SELECT label, i0, i1, {R('sqrt(sum(re * re + im * im))')} AS re, 0.0 AS im FROM cx GROUP BY 1, 2, 3")
def _(spark, sf):
    """Maps from the images themselves combine these to their root sum of squares."""
    df = coils(spark, sf)
    g = Grid(df.select("label", "i0", "i1", F.col("channel").alias("i2"), "re", "im"), (4, 8, 1 << 16), ("label",), True)
    return shown(recon.coil_combine_adaptive(g, recon.sensitivity_map_estimate(g)))


@query("recon_image_operators", f"WITH {PX} SELECT vec_id, i0, i1, {R('(greatest(least(v * 3 + 0.1, 0.4), -0.2) + 0.2) / 0.6')} AS v FROM px")
def _(spark, sf):
    g = recon.image_offset_float32(recon.image_scale_float32(images(spark, sf), 3.0), 0.1)
    return shown(recon.image_window_float32(recon.image_clamp_float32(g, -0.2, 0.4), -0.2, 0.4))


@query("recon_image_normalize", f"WITH {PX} SELECT vec_id, i0, i1, {R('(v - avg(v) OVER w) / stddev_pop(v) OVER w')} AS v FROM px WINDOW w AS (PARTITION BY vec_id)")
def _(spark, sf):
    return shown(recon.image_normalize(images(spark, sf), "zscore"))


@query("recon_image_range_check", f"WITH {PX} SELECT vec_id, count(*) FILTER (v < -0.1 OR v > 0.1) AS outside, count(*) AS pixels FROM px GROUP BY 1")
def _(spark, sf):
    return recon.image_range_check(images(spark, sf), -0.1, 0.1)["report"]


@query("recon_partial_fourier", f"WITH {CX}, {CH}, k AS (SELECT label, channel, i0, i1, re, im FROM cx JOIN ch USING (vec_id)) SELECT label, channel AS i0, i0 AS i1, i1 AS i2, {R('re')} AS re, {R('im')} AS im FROM k WHERE i0 < 3 UNION ALL SELECT label, channel, 4 - i0, (8 - i1) % 8, {R('re')}, {R('-im')} FROM k WHERE i0 = 1")
def _(spark, sf):
    df = coils(spark, sf)
    g = Grid(df.select("label", "channel", F.lit(0).alias("i0"), F.col("i0").alias("i1"), F.col("i1").alias("i2"), "re", "im"), (1, 4, 8), ("label", "channel"), True)
    out = recon.cartesian_partial_fourier(g, 3)
    return out.df.select("label", F.col("channel").alias("i0"), "i1", "i2", rnd("re").alias("re"), rnd("im").alias("im"))


# ---------------------------------------------------------------- ingest
def lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ky"), F.col("l_partkey").alias("payload"), F.col("l_shipdate").alias("arrival"), F.col("l_suppkey").alias("tie"))


_FLAG = {"error": 1 << 18, "signup": 1 << 20, "purchase": 1 << 19, "view": 0, "click": 1 << 23}


@query("ingest_classify", "SELECT event_id, CASE event_type WHEN 'error' THEN 'noise' WHEN 'signup' THEN 'calibration_and_imaging' WHEN 'purchase' THEN 'calibration' WHEN 'click' THEN 'phase_correction' ELSE 'imaging' END AS lane FROM events")
def _(spark, sf):
    f = F.lit(0).cast("long")
    for k, v in _FLAG.items():
        f = F.when(F.col("event_type") == k, F.lit(v).cast("long")).otherwise(f)
    return ingest.classify(table(spark, sf, "events").withColumn("flags", f)).select("event_id", "lane")


@query("ingest_flag_kinds", "SELECT 'imaging' AS kind, count(*) AS n FROM lineitem WHERE l_linenumber < 3 OR l_linenumber > 5 UNION ALL SELECT 'noise_measurement', count(*) FROM lineitem WHERE l_linenumber IN (3, 5) UNION ALL SELECT 'navigation', count(*) FROM lineitem WHERE l_linenumber IN (4, 5)")
def _(spark, sf):
    n = F.col("l_linenumber")
    flags = F.when(n == 3, F.lit(1 << 18)).when(n == 4, F.lit(1 << 22)).when(n == 5, F.lit((1 << 18) | (1 << 22))).when(n < 3, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return ingest.kind_counts(table(spark, sf, "lineitem").withColumn("flags", flags))


@query("ingest_duplicates_replaced", "SELECT l_orderkey, l_linenumber AS ky, arg_max(l_partkey, (l_shipdate, l_suppkey, l_partkey)) AS payload FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return ingest.deduplicated(lines(spark, sf).select("l_orderkey", "ky", F.struct("arrival", "tie").alias("arrival"), "payload"), ["l_orderkey"], ["ky"], "arrival", ["payload"], "replace_before_seal").select("l_orderkey", "ky", "payload")


@query("ingest_missing_coordinates", "SELECT o.k AS l_orderkey, y::INT AS ky FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o CROSS JOIN range(1, 8) r(y) WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.k AND l.l_linenumber = y)")
def _(spark, sf):
    return ingest.missing_coordinates(lines(spark, sf), spark.range(1, 8).select(F.col("id").cast("int").alias("ky")), ["l_orderkey"], ["ky"])


_FRAMES = "WITH f AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS ky FROM lineitem GROUP BY 1)"


def _coordinates(spark, last: int) -> DataFrame:
    """The lines 1 to `last`, which every frame must have."""
    return spark.range(1, last + 1).select(F.col("id").cast("int").alias("ky"))


@query("ingest_coverage", f"{_FRAMES} SELECT l_orderkey, len(list_filter(ky, lambda y: y <= 4)) AS covered, 4 - len(list_filter(ky, lambda y: y <= 4)) AS missing, len(list_filter(ky, lambda y: y > 4)) AS unexpected, ky = [1, 2, 3, 4] AS complete FROM f")
def _(spark, sf):
    """Of the lines 1 to 4: a frame of four others isn't whole, nor is one with a fifth."""
    return ingest.coverage(lines(spark, sf), _coordinates(spark, 4), ["l_orderkey"], ["ky"])


@query("ingest_coverage_by_frame", "WITH n AS (SELECT o_orderkey AS l_orderkey, 1 + o_custkey % 4 AS last FROM orders), c AS (SELECT l_orderkey, last, count(DISTINCT l_linenumber) FILTER (l_linenumber <= last) AS covered, count(DISTINCT l_linenumber) FILTER (l_linenumber > last) AS unexpected FROM n LEFT JOIN lineitem USING (l_orderkey) GROUP BY 1, 2) SELECT l_orderkey, covered, last - covered AS missing, unexpected, covered = last AND unexpected = 0 AS complete FROM c")
def _(spark, sf):
    """Each order asks for lines of its own; orders of which no line came are there too."""
    need = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), (1 + F.col("o_custkey") % 4).cast("int"))).alias("ky"))
    return ingest.coverage(lines(spark, sf), need, ["l_orderkey"], ["ky"])


@query("ingest_unexpected_coordinates", "SELECT l_orderkey, l_linenumber AS ky, l_partkey AS payload FROM lineitem WHERE l_linenumber > 4")
def _(spark, sf):
    return ingest.unexpected_coordinates(lines(spark, sf), _coordinates(spark, 4), ["l_orderkey"], ["ky"]).select("l_orderkey", "ky", "payload")


@query("ingest_complete_frames", f"{_FRAMES} SELECT l_orderkey, l_linenumber AS ky, l_partkey AS payload FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey IN (SELECT l_orderkey FROM f WHERE ky[1:4] = [1, 2, 3, 4])")
def _(spark, sf):
    """certified_skip: incomplete frames are left out."""
    return ingest.assembled(lines(spark, sf).where("ky <= 4"), _coordinates(spark, 4), ["l_orderkey"], ["ky"], "certified_skip").select("l_orderkey", "ky", "payload")


@query("ingest_partial_frames", "SELECT l_orderkey, l_linenumber AS ky, l_partkey AS payload FROM lineitem WHERE l_linenumber <= 4")
def _(spark, sf):
    """emit_partial: they are kept."""
    return ingest.assembled(lines(spark, sf).where("ky <= 4"), _coordinates(spark, 4), ["l_orderkey"], ["ky"], "emit_partial").select("l_orderkey", "ky", "payload")


@query("ingest_whole_frames", "SELECT l_orderkey, l_linenumber AS ky, l_partkey AS payload FROM lineitem")
def _(spark, sf):
    """fail: every frame must be whole, as each is of the lines that it has."""
    t = lines(spark, sf)
    return ingest.assembled(t, t.select("l_orderkey", "ky").distinct(), ["l_orderkey"], ["ky"], "fail").select("l_orderkey", "ky", "payload")


@query("ingest_duplicates_identical", "SELECT DISTINCT l_orderkey, l_linenumber AS ky, l_partkey % 1 AS payload FROM lineitem")
def _(spark, sf):
    """ignore_identical: every line twice, its repeats alike."""
    t = lines(spark, sf).select("l_orderkey", "ky", "arrival", (F.col("payload") % 1).alias("payload"))
    return ingest.deduplicated(t.unionByName(t), ["l_orderkey"], ["ky"], "arrival", ["payload"], "ignore_identical").select("l_orderkey", "ky", "payload")


@query("ingest_duplicates_rejected", "SELECT event_id, user_id, event_type AS payload FROM events")
def _(spark, sf):
    """reject: no event comes twice."""
    t = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("payload"))
    return ingest.deduplicated(t, ["user_id"], ["event_id"], "ts", ["payload"], "reject").select("event_id", "user_id", "payload")


@query("ingest_arrival_bounds", "SELECT l_orderkey, count(*) AS lines, date_diff('day', min(l_shipdate::DATE), max(l_shipdate::DATE)) AS span, CASE WHEN count(*) > 5 THEN 'lines' ELSE 'span' END AS error FROM lineitem GROUP BY 1 HAVING count(*) > 5 OR date_diff('day', min(l_shipdate::DATE), max(l_shipdate::DATE)) > 100")
def _(spark, sf):
    t = lines(spark, sf).withColumn("day", F.datediff(F.to_date("arrival"), F.lit("1970-01-01").cast("date")))
    return ingest.bounded_arrivals(t, ["l_orderkey"], ["ky"], "day", 5, 100).select("l_orderkey", "lines", F.col("span").cast("long").alias("span"), "error")


@query("ingest_exact_join_of_four", "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 3) + 0.0 AS total, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY 1")
def _(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey")
    sides = [t.agg(F.count("*").alias("n")), t.agg(rnd(F.sum("l_quantity"), 3).alias("total")), t.agg(F.min("l_linenumber").alias("first")), t.agg(F.max("l_linenumber").alias("last"))]
    return ingest.exact_join(sides[0], sides[1], ["l_orderkey"], *sides[2:])


@query("ingest_calibration_gate", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'wait' ELSE 'pass' END AS state FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(spark, sf):
    ready = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return ingest.gated(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), ready, ["k"]).select("o_orderkey", "state")


@query("ingest_exact_join", "SELECT a.l_orderkey, a.n, round(b.total, 3) + 0.0 AS total FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) b USING (l_orderkey)")
def _(spark, sf):
    t = table(spark, sf, "lineitem")
    return ingest.exact_join(t.groupBy("l_orderkey").agg(F.count("*").alias("n")), t.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")), ["l_orderkey"]).select("l_orderkey", "n", rnd("total", 3).alias("total"))


@query("inspect_catalog", "SELECT DISTINCT 'l_linenumber' AS dimension, l_linenumber::BIGINT AS value FROM lineitem UNION ALL SELECT DISTINCT 'l_suppkey', l_suppkey FROM lineitem")
def _(spark, sf):
    return ingest.catalog(table(spark, sf, "lineitem"), ["l_linenumber", "l_suppkey"])


@query("inspect_plane", "SELECT l_orderkey AS \"row\", l_linenumber AS col, l_extendedprice AS value FROM lineitem WHERE l_suppkey = 7")
def _(spark, sf):
    return ingest.plane(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", {"l_suppkey": 7}, "l_extendedprice")


@query("inspect_limit_violations", "SELECT l_orderkey, l_linenumber, list_filter(['l_linenumber', 'l_suppkey'], lambda x: (x = 'l_linenumber' AND l_linenumber > 5) OR (x = 'l_suppkey' AND l_suppkey < 10))::VARCHAR[] AS outside FROM lineitem WHERE l_linenumber > 5 OR l_suppkey < 10")
def _(spark, sf):
    return ingest.limit_violations(table(spark, sf, "lineitem"), {"l_linenumber": (0, 5), "l_suppkey": (10, 1 << 40)}).select("l_orderkey", "l_linenumber", "outside")


@query("inspect_display", f"WITH {CX} SELECT vec_id, i0, i1, {R(_M)} AS magnitude, {R('degrees(atan2(im, re))')} AS degrees FROM cx")
def _(spark, sf):
    df = complex_images(spark, sf).df
    return df.select("vec_id", "i0", "i1", rnd(ingest.display(F.col("re"), F.col("im"), "magnitude")).alias("magnitude"), rnd(ingest.display(F.col("re"), F.col("im"), "phase_degrees")).alias("degrees"))


@query("inspect_readout_range", "SELECT l_orderkey, l_linenumber, CASE WHEN usable THEN (l_linenumber % 3 - l_linenumber)::INT END AS first, CASE WHEN usable THEN (l_quantity::INT - l_linenumber % 2 - 1 - l_linenumber)::INT END AS last FROM (SELECT *, l_quantity::INT > 0 AND l_linenumber % 3 + l_linenumber % 2 < l_quantity::INT AND l_linenumber < l_quantity::INT AS usable FROM lineitem)")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("number_of_samples"), F.lit(1).alias("active_channels"), (F.col("l_linenumber") % 3).alias("discard_pre"), (F.col("l_linenumber") % 2).alias("discard_post"), F.col("l_linenumber").alias("center_sample"))
    return ingest.readout_range(t).select("l_orderkey", "l_linenumber", "first", "last")


@query("diagnostics_summarize", f"WITH {PX} SELECT vec_id, count(*) AS elements, count(*) FILTER (v = 0) AS zero, {R('min(v)')} AS least, {R('max(v)')} AS most, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS stddev FROM px GROUP BY 1")
def _(spark, sf):
    out = diagnostics.summarize_array(images(spark, sf))
    return out.select("vec_id", "elements", "zero", *[rnd(c).alias(c) for c in ("least", "most", "mean", "stddev")])


@query("diagnostics_compare", f"WITH {PX} SELECT a.vec_id, count(*) AS elements, count(*) FILTER (a.v <> b.v) AS different, count(*) FILTER (abs(a.v - b.v) > 0.1) AS beyond, {R('max(abs(a.v - b.v))')} AS largest, {R('sqrt(avg((a.v - b.v) * (a.v - b.v)))')} AS rmse FROM px a JOIN (SELECT vec_id, i1 AS i0, i0 AS i1, v FROM px) b USING (vec_id, i0, i1) GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    out = diagnostics.compare_arrays(g, arrays.transpose(g), 0.1)
    return out.select("vec_id", "elements", "different", "beyond", rnd("largest").alias("largest"), rnd("rmse").alias("rmse"))
