"""Queries of single operations that the ones in queries.py don't reach, over the same tables, each with the SQL it must agree
with. Formulas and weights stand in the SQL as such, never taken from the code they check."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import cplx, special
from tessera.functions import elementwise as el
from tessera.functions import windows as win
from tessera.grid import Grid, constants
from tessera.operators import arrays, fft, image, ingest, linalg, nufft, recon, signal, sparse, stats
from tessera.plans import pipeline, runs
from tessera.queries import CH, CX, PX, SIG, R, _near, coils, complex_images, images, lines, query, rnd, shown, signals, table

PI = repr(math.pi)
_M = "sqrt(re * re + im * im)"
VX = "vx AS (SELECT vec_id, i::INT AS i0, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"
CUBE = "cb AS (SELECT vec_id, (i // 16)::INT AS i0, ((i // 4) % 4)::INT AS i1, (i % 4)::INT AS i2, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"
QUAD = "q4 AS (SELECT vec_id, (i // 32)::INT AS i0, ((i // 16) % 2)::INT AS i1, ((i // 4) % 4)::INT AS i2, (i % 4)::INT AS i3, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"
#: Complex volumes of 2 x 4 x 4.
CV = "cv AS (SELECT vec_id, (i // 16)::INT AS i0, ((i // 4) % 4)::INT AS i1, (i % 4)::INT AS i2, embedding[i + 1]::DOUBLE AS re, embedding[i + 33]::DOUBLE AS im FROM embeddings, range(32) r(i))"


def vectors(spark, sf) -> Grid:
    return images(spark, sf, (64,))


def joined(named: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """One table of several with a column v (or of the name) each."""
    out = None
    for name, df in named.items():
        part = df.select(*on, F.col("v" if "v" in df.columns else name).alias(name))
        out = part if out is None else out.join(part, on)
    return out


# ---------------------------------------------------------------- building
SHAPES = {"vector": (6,), "matrix": (2, 3), "image": (3, 2), "cube": (1, 2, 3), "array4d": (1, 2, 1, 3)}


@query("array_constructors", "SELECT maker || '_' || kind AS name, i::INT AS lin, CASE maker WHEN 'full' THEN 2.5 WHEN 'ones' THEN 1.0 WHEN 'linspace' THEN round(1 + i * 0.4, 9) WHEN 'uniform_random' THEN 1.0 ELSE 0.0 END AS v FROM (VALUES ('full'), ('zeros'), ('ones'), ('linspace'), ('uniform_random'), ('make_pooled')) m(maker), (VALUES ('vector'), ('matrix'), ('image'), ('cube'), ('array4d')) k(kind), range(6) r(i)")
def _(spark, sf):
    """Of random arrays whether each element is in its interval; the rest by value."""
    out = []
    for kind, shape in SHAPES.items():
        made = {
            "full": catalog.ARRAY[f"full_{kind}"](spark, *shape, 2.5), "zeros": catalog.ARRAY[f"zeros_{kind}"](spark, *shape), "ones": catalog.ARRAY[f"ones_{kind}"](spark, *shape),
            "linspace": catalog.ARRAY[f"linspace_{kind}"](spark, *shape, 1.0, 3.0), "make_pooled": catalog.ARRAY[f"make_pooled_{kind}"](spark, *shape),
            "uniform_random": catalog.ARRAY[f"uniform_random_{kind}"](spark, *shape, 2.0, 3.0, seed=5).map(lambda v: F.when((v >= 2.0) & (v < 3.0), 1.0).otherwise(0.0)),
        }
        out += [g.df.select(F.lit(f"{maker}_{kind}").alias("name"), g.linear().cast("int").alias("lin"), F.round("v", 9).alias("v")) for maker, g in made.items()]
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


@query("array_eye_and_identity", "SELECT (i // 3)::INT AS i0, (i % 3)::INT AS i1, CASE WHEN i // 3 = i % 3 THEN 1.0 ELSE 0.0 END AS eye, CASE WHEN i // 3 = i % 3 THEN 1.0 ELSE 0.0 END AS three FROM range(9) r(i)")
def _(spark, sf):
    three = np.asarray(catalog.LINALG["identity_matrix3"]())
    rows = spark.createDataFrame([(i, j, float(three[i, j])) for i in range(3) for j in range(3)], "i0 int, i1 int, three double")
    return joined({"eye": catalog.ARRAY["eye_matrix"](spark, 3, 3).df, "three": rows}, ["i0", "i1"])


@query("array_fills", f"WITH {PX} SELECT vec_id, i0, i1, 2.5 AS filled, CASE WHEN i0 = i1 THEN 1.0 ELSE 0.0 END AS eye, {R('1 + (i0 * 8 + i1) * 2.0 / 63')} AS line, true AS inside, v AS copied FROM px")
def _(spark, sf):
    g = images(spark, sf)
    random = catalog.ARRAY["fill_uniform_random"](g, -1.0, 4.0, seed=3).df.select("vec_id", "i0", "i1", ((F.col("v") >= -1.0) & (F.col("v") < 4.0)).alias("inside"))
    return joined({"filled": arrays.fill(g, 2.5).df, "eye": arrays.set_identity(g).df, "line": shown(catalog.ARRAY["fill_linspace"](g, 1.0, 3.0)), "inside": random, "copied": arrays.copy(g).df}, ["vec_id", "i0", "i1"])


@query("array_views", f"WITH {PX} SELECT name, vec_id, {R('sum(v)')} AS total FROM px, (VALUES ('vector_view'), ('matrix_view'), ('image_view'), ('cube_view'), ('array4d_view'), ('as_const_view'), ('copy_as_matrix'), ('copy_as_image'), ('debug_view'), ('reshape_view'), ('flatten_view'), ('swap'), ('transform'), ('for_each_linear_indexed')) n(name) GROUP BY 1, 2")
def _(spark, sf):
    g = images(spark, sf)
    made = {n: catalog.ARRAY[n](g) for n in ("vector_view", "matrix_view", "image_view", "cube_view", "array4d_view", "as_const_view", "copy_as_matrix", "copy_as_image")}
    made |= {"debug_view": catalog.FILES["debug_view"](g), "reshape_view": catalog.ARRAY["reshape_view"](g, 4, 16), "flatten_view": catalog.ARRAY["flatten_view"](g), "swap": catalog.ARRAY["swap"](g, arrays.fill(g, 0.0))[1], "transform": catalog.ARRAY["transform"](g, lambda v: v)}
    made["for_each_linear_indexed"] = arrays.transform_linear_indexed(g, lambda lin, v: v + lin * F.lit(0.0))
    out = [stats.total(m).select(F.lit(n).alias("name"), "vec_id", rnd("total").alias("total")) for n, m in made.items()]
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


@query("array_contiguous_spans", f"WITH {VX} SELECT vec_id, {R('sum(v * (i0 + 1))')} AS span, {R('sum(v * (i0 + 1))')} AS tried, {R('sum(v * (i0 + 1))')} AS packed FROM vx GROUP BY 1")
def _(spark, sf):
    """The packed row of each array, whose places are those of row-major order."""
    g = images(spark, sf)
    weighed = lambda df: df.select("vec_id", rnd(F.aggregate(F.zip_with("v", F.sequence(F.lit(1), F.lit(64)), lambda v, k: v * k), F.lit(0.0), lambda a, x: a + x)).alias("v"))
    return joined({"span": weighed(catalog.ARRAY["contiguous_span"](g)), "tried": weighed(catalog.ARRAY["try_contiguous_span"](g)), "packed": weighed(catalog.ARRAY["pack_contiguous"](arrays.reverse(arrays.reverse(g))))}, ["vec_id"])


@query("array_for_each", "WITH t AS (SELECT sum(embedding[i + 1]::DOUBLE) AS s, count(*) AS n, count(DISTINCT vec_id) AS k FROM embeddings, range(64) r(i)) SELECT unnest(['for_each', 'for_each_indexed', 'for_each_contiguous_block', 'for_each_zip']) AS name, unnest([n, n, k, n]) AS calls, unnest([round(s, 3), round(s, 3), round(s, 3), round(2 * s, 3)]) + 0.0 AS total FROM t")
def _(spark, sf):
    """What the calls on the executors add up."""
    g, out = images(spark, sf), []
    for name, run, f in (
        ("for_each", catalog.ARRAY["for_each"], lambda r: r.v), ("for_each_indexed", catalog.ARRAY["for_each_indexed"], lambda r: r.v), ("for_each_contiguous_block", arrays.for_each_contiguous_block, lambda r: sum(r.v)),
        ("for_each_zip", lambda a, f: arrays.for_each_zip(a, a, f), lambda r: r.re + r.im),
    ):
        calls, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0.0)

        def visit(r, f=f, calls=calls, total=total):
            calls.add(1)
            total.add(f(r))

        run(g, visit)
        out.append((name, calls.value, round(total.value, 3) + 0.0))
    return spark.createDataFrame(out, "name string, calls long, total double")


@query("array_dim_index", "SELECT unnest(['dim0', 'dim1', 'dim2', 'dim3']) AS name, unnest([0, 1, 2, 3])::INT AS dim, unnest([NULL, 0, 1, 2])::INT AS by_mode")
def _(spark, sf):
    names = ("dim0", "dim1", "dim2", "dim3")
    return spark.createDataFrame([(n, catalog.ARRAY["dim_index"](n), catalog.FOURIER["dim_from_fft_mode"](i) if i else None) for i, n in enumerate(names)], "name string, dim int, by_mode int")


# ---------------------------------------------------------------- moving and indexing
@query("array_reversals", f"WITH {VX} SELECT vec_id, i0, v, lag(v, 0) OVER w AS same, first_value(v) OVER (PARTITION BY vec_id ORDER BY (i0 + 59) % 64) AS unused FROM vx WINDOW w AS (PARTITION BY vec_id ORDER BY i0)".split(" SELECT")[0] + " SELECT a.vec_id, a.i0, b.v AS reversed, c.v AS rotated, d.v AS shifted FROM vx a JOIN vx b ON b.vec_id = a.vec_id AND b.i0 = 63 - a.i0 JOIN vx c ON c.vec_id = a.vec_id AND c.i0 = (a.i0 + 5) % 64 JOIN vx d ON d.vec_id = a.vec_id AND d.i0 = (a.i0 + 32) % 64")
def _(spark, sf):
    g = vectors(spark, sf)
    return joined({"reversed": catalog.ARRAY["reverse_in_place"](g).df, "rotated": catalog.ARRAY["rotate_left_in_place"](g, 5).df, "shifted": catalog.FOURIER["ifftshift_in_place"](g).df}, ["vec_id", "i0"])


@query("array_ifftshift_odd", f"WITH {VX} SELECT vec_id, ((i0 - 7 + 15) % 15)::INT AS i0, v FROM vx WHERE i0 < 15")
def _(spark, sf):
    """Of an odd length the shift back isn't the shift."""
    return arrays.ifftshift(arrays.slice_axis(vectors(spark, sf), 0, 0, 15)).df


@query("array_sliding_windows_of_cubes", f"WITH {CUBE} SELECT vec_id, ((i0 - a) * 2 + i1 - b)::INT AS i0, ((a * 3 + b) * 4 + i2)::INT AS i1, v FROM cb, range(2) x(a), range(3) y(b) WHERE i0 - a BETWEEN 0 AND 2 AND i1 - b BETWEEN 0 AND 1")
def _(spark, sf):
    return arrays.extract_sliding_window_matrix(images(spark, sf, (4, 4, 4)), 2, 3).df


@query("array_sliding_patches_of_arrays", f"WITH {CUBE} SELECT vec_id, ((i1 - a) * 3 + i2 - b)::INT AS i0, ((i0 * 2 + a) * 2 + b)::INT AS i1, v FROM cb, range(2) x(a), range(2) y(b) WHERE i1 - a BETWEEN 0 AND 2 AND i2 - b BETWEEN 0 AND 2")
def _(spark, sf):
    return arrays.extract_sliding_patch_matrix(images(spark, sf, (4, 4, 4)), 2, 2).df


@query("array_indexed_transforms", f"WITH {PX} SELECT vec_id, i0, i1, {R('v + (i0 * 8 + i1) * 0.5')} AS by_place, {R('v * (i0 - i1)')} AS by_index, CASE WHEN v > 0 THEN v ELSE -1.0 END AS chosen, CASE WHEN i0 = 2 THEN v ELSE 7.0 END AS copied FROM px")
def _(spark, sf):
    g = images(spark, sf)
    copied = g.map(lambda v: el.copy_where_equal(F.col("i0"), 2, v, F.lit(7.0)))
    return joined({"by_place": shown(arrays.transform_linear_indexed(g, lambda lin, v: v + lin * 0.5)), "by_index": shown(arrays.transform_indexed(g, lambda i, j, v: v * (i - j))), "chosen": g.map(lambda v: el.where(v > 0, v, F.lit(-1.0))).df, "copied": copied.df}, ["vec_id", "i0", "i1"])


# ---------------------------------------------------------------- sums
@query("array_counts", f"WITH {PX} SELECT a.vec_id, count(*) FILTER (a.v > 0.1) AS matching, count(*) FILTER (a.v <> 0) AS nonzero, bool_and(a.v > -0.9) AS every, bool_or(a.v > 0.3) AS some, {R('coalesce(sum(a.v) FILTER (a.v > 0.1), 0)')} AS total_if, count(*) FILTER (a.v <> b.v) AS different FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.i0 = b.i1 AND a.i1 = b.i0 GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    out = arrays.count_matching(g, lambda v: v > 0.1).withColumnRenamed("n", "matching").join(stats.count_nonzero(g).withColumnRenamed("n", "nonzero"), "vec_id")
    out = out.join(stats.all_of(g, lambda v: v > -0.9).withColumnRenamed("holds", "every"), "vec_id").join(stats.any_of(g, lambda v: v > 0.3).withColumnRenamed("holds", "some"), "vec_id")
    out = out.join(stats.accumulate_if(g, lambda v: v > 0.1).select("vec_id", rnd("total").alias("total_if")), "vec_id")
    return out.join(arrays.count_not_equal(g, arrays.transpose(g)).withColumnRenamed("n", "different"), "vec_id")


@query("array_true_run_counts", f"WITH {SIG}, h AS (SELECT user_id, i0, i0 - row_number() OVER (PARTITION BY user_id ORDER BY i0) AS g FROM sig WHERE v > 20), r AS (SELECT user_id, g FROM h GROUP BY 1, 2 HAVING count(*) >= 3) SELECT user_id, count(*) AS n FROM r GROUP BY 1")
def _(spark, sf):
    return arrays.count_true_runs(Grid(signals(spark, sf), (1,), ("user_id",)), lambda v: v > 20, 3)


@query("array_folds", "SELECT vec_id, round(list_reduce(list_prepend(0.0, embedding::DOUBLE[]), lambda a, x: a * 0.5 + x), 6) + 0.0 AS v FROM embeddings")
def _(spark, sf):
    """A step whose order matters: half of what came before, and the element."""
    return arrays.accumulate(images(spark, sf), F.lit(0.0), lambda a, x: a * 0.5 + x).select("vec_id", rnd("v").alias("v"))


@query("array_reduced_extremes", f"WITH {PX} SELECT vec_id, i0, {R('max(v)')} AS most, arg_min(i1, (-v, i1))::DOUBLE AS most_at, arg_min(i1, (v, i1))::DOUBLE AS least_at FROM px GROUP BY 1, 2")
def _(spark, sf):
    g = images(spark, sf)
    at = catalog.ARRAY["reduce_extreme_index"]
    return joined({"most": shown(catalog.ARRAY["reduce_extreme"](g, 1, F.max)), "most_at": at(g, 1, largest=True).df, "least_at": at(g, 1).df}, ["vec_id", "i0"])


@query("array_products_across", f"WITH {CUBE} SELECT a.vec_id, a.i0, a.i1, {R('sum(a.v * b.v)')} AS product, {R('sqrt(sum(a.v * a.v))')} AS rss FROM cb a JOIN cb b ON a.vec_id = b.vec_id AND b.i0 = 3 - a.i0 AND b.i1 = a.i1 AND b.i2 = a.i2 GROUP BY 1, 2, 3")
def _(spark, sf):
    g = images(spark, sf, (4, 4, 4))
    return joined({"product": shown(arrays.sum_product_across(g, arrays.reverse_rows(g))), "rss": shown(arrays.root_sum_of_squares_across(g, 2))}, ["vec_id", "i0", "i1"])


@query("array_cube_by_array4d", f"WITH {QUAD}, c AS (SELECT vec_id, i1, i2, i3, sum(v) AS s, sum(abs(v)) AS a FROM q4 GROUP BY 1, 2, 3, 4) SELECT q4.vec_id, q4.i0, q4.i1, q4.i2, q4.i3, {R('v * s')} AS product, {R('s * a * a')} AS squared FROM q4 JOIN c USING (vec_id, i1, i2, i3)")
def _(spark, sf):
    """A cube by each of the cubes of an array of rank 4, and a cube by the square of their summed magnitudes."""
    g = images(spark, sf, (2, 2, 4, 4))
    cube = arrays.sum_axis(g, 0)
    squared = catalog.ARRAY["multiply_cube_by_abs_sum_squared_in_place"](cube, g).df.select("vec_id", F.col("i0").alias("i1"), F.col("i1").alias("i2"), F.col("i2").alias("i3"), rnd("v").alias("squared"))
    product = shown(arrays.multiply_cube_by_array4d(cube, g)).withColumnRenamed("v", "product")
    return product.join(squared, ["vec_id", "i1", "i2", "i3"]).select("vec_id", "i0", "i1", "i2", "i3", "product", "squared")


@query("array_cube_by_abs_sum_squared", f"WITH {QUAD}, c AS (SELECT vec_id, i1, i2, i3, sum(v) AS s, sum(abs(v)) AS a FROM q4 GROUP BY 1, 2, 3, 4) SELECT vec_id, i1 AS i0, i2 AS i1, i3 AS i2, {R('s * a * a')} AS v FROM c")
def _(spark, sf):
    g = images(spark, sf, (2, 2, 4, 4))
    return shown(arrays.multiply_cube_by_abs_sum_squared(arrays.sum_axis(g, 0), g))


# ---------------------------------------------------------------- complex
@query("complex_parts", f"WITH {CX} SELECT vec_id, i0, i1, {R('re')} AS re, {R('im')} AS im, {R('re')} AS joined_re, {R('im')} AS joined_im, {R('re')} AS real_re, 0.0 AS real_im FROM cx")
def _(spark, sf):
    df = complex_images(spark, sf).df
    a, b = F.col("re"), F.col("im")
    re, im = cplx.split_complex(a, b)
    jr, ji = cplx.complex_from_real_imag(a, b)
    rr, ri = cplx.complex_from_real(a)
    return df.select("vec_id", "i0", "i1", *[rnd(c).alias(n) for n, c in (("re", re), ("im", im), ("joined_re", jr), ("joined_im", ji), ("real_re", rr), ("real_im", ri))])


@query("complex_sums", f"WITH {CX} SELECT a.vec_id, a.i0, a.i1, {R('a.re + b.re')} AS add_re, {R('a.im + b.im')} AS add_im, {R('a.re - b.re')} AS sub_re, {R('a.im - b.im')} AS sub_im, {R('1 + 3 * (a.re * b.re + a.im * b.im)')} AS acc_re, {R('2 + 3 * (a.re * b.im - a.im * b.re)')} AS acc_im FROM cx a JOIN cx b ON a.vec_id = b.vec_id AND b.i0 = 3 - a.i0 AND a.i1 = b.i1")
def _(spark, sf):
    g = complex_images(spark, sf)
    other = arrays.reverse_rows(g)
    acc = g.zip(other, lambda a, b, c, d: cplx.accumulate_conjugate_product_scaled(F.lit(1.0), F.lit(2.0), a, b, c, d, 3.0))
    out = None
    for n, z in (("add", g.zip(other, cplx.add)), ("sub", g.zip(other, cplx.subtract)), ("acc", acc)):
        part = z.df.select("vec_id", "i0", "i1", rnd("re").alias(f"{n}_re"), rnd("im").alias(f"{n}_im"))
        out = part if out is None else out.join(part, ["vec_id", "i0", "i1"])
    return out


@query("elementwise_sums", f"WITH {PX} SELECT a.vec_id, a.i0, a.i1, {R('a.v + b.v')} AS added, {R('a.v - b.v')} AS subtracted, {R('a.v * b.v')} AS multiplied, {R('a.v / (b.v * b.v + 1)')} AS divided FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.i0 = b.i1 AND a.i1 = b.i0")
def _(spark, sf):
    g = images(spark, sf)
    t = arrays.transpose(g)
    add, subtract, multiply, divide = (catalog.IMAGE[f"cwise_{n}"] for n in ("add", "subtract", "multiply", "divide"))
    return joined({"added": shown(add(g, t)), "subtracted": shown(subtract(g, t)), "multiplied": shown(multiply(g, t)), "divided": shown(divide(g, t.map(lambda v: v * v + 1.0)))}, ["vec_id", "i0", "i1"])


@query("elementwise_by_scalars", f"WITH {PX} SELECT vec_id, i0, i1, {R('v + 1.5')} AS added, {R('v - 1.5')} AS subtracted, {R('v * 1.5')} AS multiplied, {R('v / 1.5')} AS divided, {R('abs(v)')} AS size, {R('v * v')} AS squared, {R('sqrt(abs(v))')} AS root FROM px")
def _(spark, sf):
    g = images(spark, sf)
    made = {n: catalog.IMAGE[f"cwise_{op}_scalar"](g, 1.5) for n, op in (("added", "add"), ("subtracted", "subtract"), ("multiplied", "multiply"), ("divided", "divide"))}
    made |= {"size": catalog.IMAGE["cwise_abs"](g), "squared": catalog.IMAGE["cwise_square"](g), "root": catalog.IMAGE["cwise_sqrt"](catalog.IMAGE["cwise_abs"](g))}
    return joined({n: shown(m) for n, m in made.items()}, ["vec_id", "i0", "i1"])


@query("elementwise_divide_ieee", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN ((n_nationkey - 12) / (n_nationkey % 5))::DOUBLE::VARCHAR WHEN n_nationkey = 12 THEN 'NaN' WHEN n_nationkey > 12 THEN 'Infinity' ELSE '-Infinity' END AS v FROM nation".replace("((n_nationkey - 12) / (n_nationkey % 5))::DOUBLE::VARCHAR", "round((n_nationkey - 12)::DOUBLE / (n_nationkey % 5), 6)::VARCHAR"))
def _(spark, sf):
    k = F.col("n_nationkey")
    v = el.divide((k - 12).cast("double"), (k % 5).cast("double"))
    return table(spark, sf, "nation").select(k.alias("k"), F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), v).otherwise(F.round(v, 6)).cast("string").alias("v"))


@query("elementwise_floor_mod_fix", "SELECT p_partkey, round(CASE WHEN abs(m - 0.7) < 1e-9 THEN 0 ELSE m END, 6) + 0.0 AS v FROM (SELECT p_partkey, p_retailprice - floor(p_retailprice / 0.7) * 0.7 AS m FROM part)")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rnd(el.floor_mod_fix(F.col("p_retailprice"), F.lit(0.7), 1e-10)).alias("v"))


# ---------------------------------------------------------------- statistics
@query("stats_each_moment", f"WITH {PX} SELECT vec_id, {R('sum(v)')} AS total, {R('avg(v)')} AS mean, {R('var_samp(v)')} AS variance, {R('avg(v)')} AS pair_mean, {R('stddev_pop(v)')} AS stddev, {R('sum(v * v)')} AS squares, {R('sqrt(sum(v * v))')} AS root, {R('sum(abs(v))')} AS l1, {R('max(abs(v))')} AS linf, {R('sqrt(avg(v * v))')} AS rmse, {R('min(v)')} AS least, {R('max(v)')} AS most, arg_min(i0 * 8 + i1, (v, i0 * 8 + i1))::BIGINT AS least_at, arg_min(i0 * 8 + i1, (-v, i0 * 8 + i1))::BIGINT AS most_at FROM px GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    out = stats.total(g)
    for df in (stats.mean(g), stats.variance(g), stats.mean_stddev(g).withColumnRenamed("mean", "pair_mean"), stats.min_max(g)):
        out = out.join(df, "vec_id")
    for name, df in (("squares", stats.sum_of_squares(g)), ("l1", stats.sum_abs(g))):
        out = out.join(df.withColumnRenamed("total", name), "vec_id")
    for name, df in (("root", stats.root_sum_of_squares(g)), ("linf", stats.max_abs(g))):
        out = out.join(df.withColumnRenamed("norm", name), "vec_id")
    out = out.join(stats.rmse(g), "vec_id").join(stats.min_index(g), "vec_id").join(stats.max_index(g), "vec_id")
    return out.select("vec_id", *[rnd(c).alias(c) for c in ("total", "mean", "variance", "pair_mean", "stddev", "squares", "root", "l1", "linf", "rmse", "least", "most")], "least_at", "most_at")


@query("stats_complex_moments", f"WITH {CX} SELECT vec_id, {R('avg(re)')} AS re, {R('avg(im)')} AS im, {R(f'sum(re * re + im * im)')} AS squares, {R(f'sqrt(sum(re * re + im * im))')} AS norm, {R(f'sum({_M})')} AS l1, {R(f'max({_M})')} AS linf, count(*) FILTER (re <> 0 OR im <> 0) AS n FROM cx GROUP BY 1")
def _(spark, sf):
    g = complex_images(spark, sf)
    out = stats.mean(g).join(stats.squared_norm(g).withColumnRenamed("total", "squares"), "vec_id").join(stats.norm(g), "vec_id")
    out = out.join(stats.norm_l1(g).withColumnRenamed("total", "l1"), "vec_id").join(stats.norm_inf(g).withColumnRenamed("norm", "linf"), "vec_id").join(stats.count_nonzero(g), "vec_id")
    return out.select("vec_id", *[rnd(c).alias(c) for c in ("re", "im", "squares", "norm", "l1", "linf")], "n")


@query("stats_each_distance", f"WITH {PX}, d AS (SELECT a.vec_id, a.v - b.v AS d FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.i0 = b.i1 AND a.i1 = b.i0) SELECT vec_id, {R('sum(abs(d))')} AS l1, {R('sqrt(sum(d * d))')} AS l2, {R('max(abs(d))')} AS linf, {R('sum(d * d)')} AS squared, {R('sqrt(avg(d * d))')} AS rmse, max(abs(d)) <= 0.4 AS close, max(abs(d)) <= 0.2 AS equal FROM d GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    t = arrays.transpose(g)
    out = stats.l1_distance(g, t).withColumnRenamed("total", "l1").join(stats.l2_distance(g, t).withColumnRenamed("norm", "l2"), "vec_id").join(stats.linf_distance(g, t).withColumnRenamed("norm", "linf"), "vec_id")
    out = out.join(stats.squared_distance(g, t).withColumnRenamed("total", "squared"), "vec_id").join(stats.rmse(g, t), "vec_id")
    out = out.join(stats.all_close(g, t, 0.4), "vec_id").join(stats.equal(g, t, 0.2).withColumnRenamed("close", "equal"), "vec_id")
    return out.select("vec_id", *[rnd(c).alias(c) for c in ("l1", "l2", "linf", "squared", "rmse")], "close", "equal")


@query("stats_norm_differences", f"WITH {PX}, d AS (SELECT a.vec_id, a.v - b.v AS d FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.i0 = 7 - a.i0 AND a.i1 = b.i1) SELECT vec_id, {R('sum(abs(d))')} AS l1, {R('sqrt(sum(d * d))')} AS l2, {R('max(abs(d))')} AS linf, {R('sum(d * d)')} AS squared FROM d GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf)
    t = arrays.reverse_rows(g)
    out = stats.norm_diff_l1(g, t).withColumnRenamed("total", "l1").join(stats.norm_diff_l2(g, t).withColumnRenamed("norm", "l2"), "vec_id").join(stats.norm_diff_inf(g, t).withColumnRenamed("norm", "linf"), "vec_id")
    out = out.join(stats.squared_l2_distance(g, t).withColumnRenamed("total", "squared"), "vec_id")
    return out.select("vec_id", *[rnd(c).alias(c) for c in ("l1", "l2", "linf", "squared")])


# ---------------------------------------------------------------- Fourier
def _dft(sign: int, dims: dict[str, int], shift: bool = False) -> str:
    """The angle of a transform over axes i0, i1, ... of these lengths at the frequencies f0, f1, ..., both from the middle if shifted."""
    at = lambda i, n: f"({i} - {n // 2})" if shift else i
    return f"{sign * 2 * math.pi!r} * (" + " + ".join(f"{at(i, n)} * {at(i.replace('i', 'f'), n)} / {n}.0" for i, n in dims.items()) + ")"


def _volume(sign: int, shift: bool, scale: str, table: str = "cv", dims=(("i0", 2), ("i1", 4), ("i2", 4))) -> tuple[str, str]:
    a = _dft(sign, dict(dims), shift)
    return f"sum(re * cos({a}) - im * sin({a})){scale}", f"sum(re * sin({a}) + im * cos({a})){scale}"


def _volume_sql(sign: int, shift: bool, scale: str) -> str:
    re, im = _volume(sign, shift, scale)
    return f"WITH {CV} SELECT vec_id, f0::INT AS i0, f1::INT AS i1, f2::INT AS i2, {R(re)} AS re, {R(im)} AS im FROM cv, range(2) a(f0), range(4) b(f1), range(4) c(f2) GROUP BY 1, 2, 3, 4"


def volumes(spark, sf) -> Grid:
    return complex_images(spark, sf, (2, 4, 4))


for _n, _f, _sign, _shift, _scale in (
    ("fft3", lambda g: fft.fft3(g), -1, False, ""), ("ifft3", lambda g: fft.ifft3(g), 1, False, " / 32"), ("fft3_centered", lambda g: fft.fft3_centered(g), -1, True, ""), ("ifft3_centered", lambda g: fft.ifft3_centered(g), 1, True, " / 32"),
    ("fft3_centered_volume", lambda g: catalog.FOURIER["fft3_centered_volume_batch_in_place_input"](g), -1, True, ""), ("ifft3_centered_volume", lambda g: catalog.FOURIER["ifft3_centered_volume_batch_in_place_input"](g), 1, True, " / 32"),
):
    query(f"fourier_{_n}", _volume_sql(_sign, _shift, _scale))(lambda spark, sf, f=_f: shown(f(volumes(spark, sf))))


def _batch_sql(sign: int, scale: str) -> str:
    a = _dft(sign, {"i0": 2, "i1": 2, "i2": 4})
    return f"WITH b AS (SELECT vec_id, (i // 16)::INT AS i0, ((i // 8) % 2)::INT AS i1, ((i // 2) % 4)::INT AS i2, (i % 2)::INT AS i3, embedding[i + 1]::DOUBLE AS re, embedding[i + 33]::DOUBLE AS im FROM embeddings, range(32) r(i)) SELECT vec_id, f0::INT AS i0, f1::INT AS i1, f2::INT AS i2, i3, {R(f'sum(re * cos({a}) - im * sin({a})){scale}')} AS re, {R(f'sum(re * sin({a}) + im * cos({a})){scale}')} AS im FROM b, range(2) x(f0), range(2) y(f1), range(4) z(f2) GROUP BY 1, 2, 3, 4, 5"


for _n, _f, _sign, _scale in (
    ("fft3_batch", lambda g: fft.fft3_batch(g), -1, ""), ("ifft3_batch", lambda g: catalog.FOURIER["ifft3_batch"](g), 1, " / 16"), ("fft3_volume_batch", lambda g: catalog.FOURIER["fft3_volume_batch"](g), -1, ""),
    ("ifft3_volume_batch", lambda g: catalog.FOURIER["ifft3_volume_batch"](g), 1, " / 16"),
):
    query(f"fourier_{_n}", _batch_sql(_sign, _scale))(lambda spark, sf, f=_f: shown(f(complex_images(spark, sf, (2, 2, 4, 2)))))


def _plane_sql(sign: int, scale: str) -> str:
    a = _dft(sign, {"i0": 4, "i1": 8})
    return f"WITH {CX} SELECT vec_id, f0::INT AS i0, f1::INT AS i1, {R(f'sum(re * cos({a}) - im * sin({a})){scale}')} AS re, {R(f'sum(re * sin({a}) + im * cos({a})){scale}')} AS im FROM cx, range(4) x(f0), range(8) y(f1) GROUP BY 1, 2, 3"


def _line_sql(sign: int) -> str:
    a = f"{sign * 2 * math.pi!r} * (i * f % 32) / 32.0"
    return f"WITH c AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS re, embedding[i + 33]::DOUBLE AS im FROM embeddings, range(32) r(i)) SELECT vec_id, f::INT AS i0, {R(f'sum(re * cos({a}) - im * sin({a})) / {math.sqrt(32)!r}')} AS re, {R(f'sum(re * sin({a}) + im * cos({a})) / {math.sqrt(32)!r}')} AS im FROM c, range(32) r(f) GROUP BY 1, 2"


query("fourier_ifft2", _plane_sql(1, " / 32"))(lambda spark, sf: shown(fft.ifft2(complex_images(spark, sf))))
query("fourier_ifft2_inplace", _plane_sql(1, " / 32"))(lambda spark, sf: shown(catalog.FOURIER["ifft2_inplace"](complex_images(spark, sf))))
query("fourier_fft_orthonormal", _line_sql(-1))(lambda spark, sf: shown(fft.fft(complex_images(spark, sf, (32,)), "orthonormal")))
query("fourier_ifft_orthonormal", _line_sql(1))(lambda spark, sf: shown(fft.ifft(complex_images(spark, sf, (32,)), "orthonormal")))


@query("fourier_ifft_segmented", f"WITH c AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS re, embedding[i + 33]::DOUBLE AS im FROM embeddings, range(32) r(i)) SELECT vec_id, ((i // 8) * 8 + f)::INT AS i0, {R(f'sum(re * cos({2 * math.pi!r} * (i % 8) * f / 8.0) - im * sin({2 * math.pi!r} * (i % 8) * f / 8.0)) / 8')} AS re, {R(f'sum(re * sin({2 * math.pi!r} * (i % 8) * f / 8.0) + im * cos({2 * math.pi!r} * (i % 8) * f / 8.0)) / 8')} AS im FROM c, range(8) r(f) GROUP BY 1, 2")
def _(spark, sf):
    return shown(fft.ifft_segmented(complex_images(spark, sf, (32,)), 4))


_KER = "k AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, 2.0), (0, 2, 0.5), (1, 0, -1.0), (1, 1, 3.0), (1, 2, 1.0), (2, 0, 0.0), (2, 1, 1.0), (2, 2, 2.0)) t(a, b, w))"
_K3 = np.array([[1.0, 2.0, 0.5], [-1.0, 3.0, 1.0], [0.0, 1.0, 2.0]])
for _op, _row, _col in (("convolve", "i0 + a", "i1 + b"), ("correlate", "i0 - a + 2", "i1 - b + 2")):
    for _mode, _cut, _size in (("full", 0, 10), ("same", 1, 8), ("valid", 2, 6)):
        _sql = f"WITH {PX}, {_KER} SELECT vec_id, ({_row} - {_cut})::INT AS i0, ({_col} - {_cut})::INT AS i1, {R('sum(v * w)')} AS v FROM px, k WHERE {_row} - {_cut} BETWEEN 0 AND {_size - 1} AND {_col} - {_cut} BETWEEN 0 AND {_size - 1} GROUP BY 1, 2, 3"
        query(f"fourier_{_op}2d_{_mode}", _sql)(lambda spark, sf, n=f"{_op}2d_{_mode}_fft": shown(catalog.FOURIER[n](images(spark, sf), _K3)))


# ---------------------------------------------------------------- small matrices, whose factors have closed forms
#: Each embedding as 16 matrices ((p, q), (r, s)) of 2 x 2 and as 8 of 4 x 2.
SM = "sm AS (SELECT vec_id, b::INT AS b, embedding[4 * b + 1]::DOUBLE AS p, embedding[4 * b + 2]::DOUBLE AS q, embedding[4 * b + 3]::DOUBLE AS r, embedding[4 * b + 4]::DOUBLE AS s FROM embeddings, range(16) t(b))"
#: ((p + 2, q), (r, s + 2)), and the products of its columns plus 1 on the diagonal: ((x, y), (y, z)).
SPD = f"{SM}, w AS (SELECT vec_id, b, p + 2 AS p, q, r, s + 2 AS s FROM sm), g AS (SELECT vec_id, b, p * p + r * r + 1 AS x, p * q + r * s AS y, q * q + s * s + 1 AS z FROM w)"
TALL = "m4 AS (SELECT vec_id, b::INT AS b, k::INT AS k, embedding[8 * b + 2 * k + 1]::DOUBLE + CASE WHEN k = 0 THEN 3 ELSE 0 END AS u, embedding[8 * b + 2 * k + 2]::DOUBLE + CASE WHEN k = 1 THEN 3 ELSE 0 END AS v FROM embeddings, range(8) t(b), range(4) j(k)), n4 AS (SELECT vec_id, b, sum(u * u) AS x, sum(u * v) AS y, sum(v * v) AS z FROM m4 GROUP BY 1, 2)"


def blocks(spark, sf, shape: tuple[int, int], more: float) -> Grid:
    """Matrices cut from each embedding (keys vec_id, b), with `more` on the diagonal."""
    n = shape[0] * shape[1]
    df = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(64 // n - 1)), lambda b: F.slice("embedding", b * n + 1, n))).alias("b", "m"))
    from tessera.grid import from_arrays

    g = from_arrays(df, "m", shape, ("vec_id", "b"))
    return linalg.add_to_diagonal(g, more) if more else g


def spd(spark, sf) -> Grid:
    return linalg.add_to_diagonal(linalg.hermitian_gram(blocks(spark, sf, (2, 2), 2.0)), 1.0)


def entries(*rows: tuple[int, int, str], table: str = "g", digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT vec_id, b, {i} AS i0, {j} AS i1, {R(e, digits)} AS v FROM {table}" for i, j, e in rows)


@query("linalg_determinant", f"WITH {SPD} SELECT vec_id, b, 0 AS i0, {R('p * s - q * r')} AS v FROM w")
def _(spark, sf):
    return shown(linalg.determinant(blocks(spark, sf, (2, 2), 2.0)))


@query("linalg_inverse_entries", f"WITH {SPD} " + entries((0, 0, "s / (p * s - q * r)"), (0, 1, "-q / (p * s - q * r)"), (1, 0, "-r / (p * s - q * r)"), (1, 1, "p / (p * s - q * r)"), table="w"))
def _(spark, sf):
    return shown(linalg.inverse(blocks(spark, sf, (2, 2), 2.0)))


@query("linalg_singular_value_entries", f"WITH {SPD}, e AS (SELECT vec_id, b, p * p + q * q + r * r + s * s AS t, sqrt(pow(p * p + q * q - r * r - s * s, 2) + 4 * pow(p * r + q * s, 2)) AS d FROM w) SELECT vec_id, b, 0 AS i0, {R('sqrt((t + d) / 2)')} AS v FROM e UNION ALL SELECT vec_id, b, 1, {R('sqrt((t - d) / 2)')} FROM e")
def _(spark, sf):
    return shown(linalg.singular_values(blocks(spark, sf, (2, 2), 2.0)))


@query("linalg_eigenvalue_entries", f"WITH {SPD}, e AS (SELECT vec_id, b, (x + z) / 2 AS m, sqrt((x - z) * (x - z) / 4 + y * y) AS d FROM g) SELECT vec_id, b, 0 AS i0, {R('m - d')} AS v FROM e UNION ALL SELECT vec_id, b, 1, {R('m + d')} FROM e")
def _(spark, sf):
    return shown(catalog.LINALG["self_adjoint_eigen_decomposition"](spd(spark, sf))[0])


@query("linalg_general_eigenvalues", f"WITH {SM}, e AS (SELECT vec_id, b, (p + s) / 2 AS m, (p - s) * (p - s) / 4 + q * r AS d FROM sm) SELECT vec_id, b, 0 AS i0, {R('CASE WHEN d >= 0 THEN m - sqrt(d) ELSE m END', 5)} AS re, {R('CASE WHEN d < 0 THEN -sqrt(-d) ELSE 0 END', 5)} AS im FROM e UNION ALL SELECT vec_id, b, 1, {R('CASE WHEN d >= 0 THEN m + sqrt(d) ELSE m END', 5)}, {R('CASE WHEN d < 0 THEN sqrt(-d) ELSE 0 END', 5)} FROM e")
def _(spark, sf):
    return shown(catalog.LINALG["eigen_decomposition"](blocks(spark, sf, (2, 2), 0.0))[0], 5)


@query("linalg_eigenvector_residuals", f"WITH {SPD} SELECT vec_id, b, 0.0 AS self_adjoint, 0.0 AS general, 2.0 AS lengths FROM w")
def _(spark, sf):
    """A v - v w of all eigenpairs, and the squared lengths of the vectors of a general matrix."""
    a, c = spd(spark, sf), blocks(spark, sf, (2, 2), 2.0)

    def off(m: Grid, pair) -> DataFrame:
        values, vectors = pair
        left = linalg.contract(m if not vectors.is_complex else m.map(lambda v: (v, F.lit(0.0))), vectors, 1, 0)
        w = values.df.select(*values.keys, F.col("i0").alias("i1"), *[F.col(x).alias(f"w_{x}") for x in values.values])
        z = vectors.df.join(w, [*values.keys, "i1"])
        if vectors.is_complex:
            right = z.select(*values.keys, "i0", "i1", (F.col("re") * F.col("w_re") - F.col("im") * F.col("w_im")).alias("x_re"), (F.col("re") * F.col("w_im") + F.col("im") * F.col("w_re")).alias("x_im"))
            size = F.hypot(F.col("re") - F.col("x_re"), F.col("im") - F.col("x_im"))
        else:
            right, size = z.select(*values.keys, "i0", "i1", (F.col("v") * F.col("w_v")).alias("x_v")), F.abs(F.col("v") - F.col("x_v"))
        return left.df.join(right, [*values.keys, "i0", "i1"]).groupBy(*values.keys).agg(rnd(F.max(size)).alias("v"))

    general = catalog.LINALG["eigen_decomposition"](c)
    lengths = stats.squared_norm(general[1]).select("vec_id", "b", rnd("total").alias("lengths"))
    return joined({"self_adjoint": off(a, catalog.LINALG["self_adjoint_eigen_decomposition_with_workspace"](a)), "general": off(c, general)}, ["vec_id", "b"]).join(lengths, ["vec_id", "b"])


@query("linalg_svd_rebuilt", f"WITH {SPD}, f AS (" + entries((0, 0, "p"), (0, 1, "q"), (1, 0, "r"), (1, 1, "s"), table="w") + ") SELECT vec_id, b, i0, i1, v AS thin, v AS whole, CASE WHEN i0 = i1 THEN 1.0 ELSE 0.0 END AS left_square FROM f")
def _(spark, sf):
    """U diag(s) V^H of the thin and the full decomposition, and U^H U of the left vectors."""
    a = blocks(spark, sf, (2, 2), 2.0)

    def rebuilt(parts) -> Grid:
        u, s, vh = parts
        scaled = u.df.join(s.df.select(*s.keys, F.col("i0").alias("i1"), F.col("v").alias("s")), [*s.keys, "i1"]).select(*u.keys, "i0", "i1", (F.col("v") * F.col("s")).alias("v"))
        return linalg.contract(Grid(scaled, u.shape, u.keys), vh, 1, 0)

    left = linalg.left_singular_vectors(a)
    return joined({"thin": shown(rebuilt(catalog.LINALG["svd_in_place"](a))), "whole": shown(rebuilt(catalog.LINALG["full_svd_in_place"](a))), "left_square": shown(linalg.hermitian_gram(left))}, ["vec_id", "b", "i0", "i1"])


@query("linalg_cholesky_entries", f"WITH {SPD} " + entries((0, 0, "sqrt(x)"), (0, 1, "0"), (1, 0, "y / sqrt(x)"), (1, 1, "sqrt(z - y * y / x)")))
def _(spark, sf):
    return shown(linalg.cholesky_lower(spd(spark, sf)))


_SOLVED = ("solve", "solve_lu", "solve_small", "solve_refined", "try_solve_refined", "solve_cholesky", "solve_qr", "solve_least_squares_svd")


@query("linalg_solvers", f"WITH {SPD}, e AS (SELECT vec_id, b, 0 AS i0, {R('(z - 2 * y) / (x * z - y * y)')} AS v FROM g UNION ALL SELECT vec_id, b, 1, {R('(2 * x - y) / (x * z - y * y)')} FROM g) SELECT vec_id, b, i0, " + ", ".join(f"v AS {n}" for n in _SOLVED) + " FROM e")
def _(spark, sf):
    """A x = (1, 2) by each solver."""
    a = spd(spark, sf)
    rhs = arrays.select_index(a, 1, 0)
    b = rhs.map(lambda _: F.col("i0") + 1.0)
    return joined({n: shown(catalog.LINALG[n](a, b)) for n in _SOLVED}, ["vec_id", "b", "i0"])


@query("linalg_pseudo_inverse", f"WITH {TALL} SELECT vec_id, b, 0 AS i0, k AS i1, {R('(z * u - y * v) / (x * z - y * y)')} AS v FROM m4 JOIN n4 USING (vec_id, b) UNION ALL SELECT vec_id, b, 1, k, {R('(x * v - y * u) / (x * z - y * y)')} FROM m4 JOIN n4 USING (vec_id, b)")
def _(spark, sf):
    return shown(linalg.pseudo_inverse(blocks(spark, sf, (4, 2), 3.0)))


@query("linalg_least_squares", f"WITH {TALL}, h AS (SELECT vec_id, b, sum(u * (k + 1)) AS c, sum(v * (k + 1)) AS d FROM m4 GROUP BY 1, 2), e AS (SELECT vec_id, b, 0 AS i0, {R('(z * c - y * d) / (x * z - y * y)')} AS v FROM h JOIN n4 USING (vec_id, b) UNION ALL SELECT vec_id, b, 1, {R('(x * d - y * c) / (x * z - y * y)')} FROM h JOIN n4 USING (vec_id, b)) SELECT vec_id, b, i0, v AS qr, v AS svd, v AS normal_equations, v AS by_four_by_two FROM e")
def _(spark, sf):
    a = blocks(spark, sf, (4, 2), 3.0)
    b = arrays.select_index(a, 1, 0).map(lambda _: F.col("i0") + 1.0)
    made = {m: shown(linalg.solve_least_squares(a, b, m)) for m in ("qr", "svd", "normal_equations")}
    return joined(made | {"by_four_by_two": shown(catalog.LINALG["least_squares_4x2"](a, b))}, ["vec_id", "b", "i0"])


@query("linalg_four_by_two", f"WITH {TALL} SELECT vec_id, b, 0 AS i0, 0 AS i1, 1.0 AS v FROM n4 UNION ALL SELECT vec_id, b, 0, 1, 0.0 FROM n4 UNION ALL SELECT vec_id, b, 1, 0, 0.0 FROM n4 UNION ALL SELECT vec_id, b, 1, 1, 1.0 FROM n4")
def _(spark, sf):
    """The pseudo-inverse by the matrix."""
    a = blocks(spark, sf, (4, 2), 3.0)
    return shown(catalog.LINALG["multiply"](catalog.LINALG["pseudo_inverse_4x2"](a), a))


@query("linalg_whitening", f"WITH {SPD}, h AS (SELECT vec_id, b, x, y, z, sqrt(x * z - y * y) AS d, sqrt(x + z + 2 * sqrt(x * z - y * y)) AS t FROM g), i AS (SELECT vec_id, b, (z + d) / (d * t) AS x, -y / (d * t) AS y, (x + d) / (d * t) AS z FROM h) " + entries((0, 0, "x"), (0, 1, "y"), (1, 0, "y"), (1, 1, "z"), table="i"))
def _(spark, sf):
    """The inverse square root of a covariance."""
    return shown(linalg.whitening_matrix_from_covariance(spd(spark, sf)))


@query("linalg_whitened_samples", f"WITH {SPD}, h AS (SELECT vec_id, b, x, y, z, sqrt(x * z - y * y) AS d, sqrt(x + z + 2 * sqrt(x * z - y * y)) AS t FROM g), i AS (SELECT w.vec_id, w.b, p, q, r, s, (z + d) / (d * t) AS x, -y / (d * t) AS y, (x + d) / (d * t) AS z FROM h JOIN w USING (vec_id, b)) " + entries((0, 0, "p * x + q * y"), (0, 1, "p * y + q * z"), (1, 0, "r * x + s * y"), (1, 1, "r * y + s * z"), table="i"))
def _(spark, sf):
    w = catalog.LINALG["whitening_matrix_from_self_adjoint_eigen_with_workspace"](spd(spark, sf))
    return shown(linalg.whiten_samples(blocks(spark, sf, (2, 2), 2.0), w))


_TWO = "two AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x, embedding[i + 33]::DOUBLE AS y FROM embeddings, range(32) r(i)), c2 AS (SELECT vec_id, var_samp(x) AS a, covar_samp(x, y) AS c, var_samp(y) AS d FROM two GROUP BY 1)"


@query("linalg_cholesky_prewhiten", f"WITH {_TWO}, f AS (SELECT vec_id, 1 / sqrt(a) AS p, -c / a / sqrt(d - c * c / a) AS q, 1 / sqrt(d - c * c / a) AS r FROM c2) SELECT vec_id, 0 AS i0, i::INT AS i1, {R('p * x')} AS v FROM two JOIN f USING (vec_id) UNION ALL SELECT vec_id, 1, i::INT, {R('q * x + r * y')} FROM two JOIN f USING (vec_id)")
def _(spark, sf):
    """Two channels of 32 samples, whitened by the factor of their own covariance."""
    samples = images(spark, sf, (2, 32))
    return shown(linalg.apply_cholesky_prewhiten(linalg.cholesky_prewhiten_calibration(samples)[0], samples))


@query("linalg_cholesky_deviations", f"WITH {_TWO} SELECT vec_id, {R('(sqrt(a) + sqrt(d)) / 2')} AS sigma, {R('least(sqrt(a), sqrt(d))')} AS least, {R('greatest(sqrt(a), sqrt(d))')} AS largest FROM c2")
def _(spark, sf):
    found = linalg.cholesky_prewhiten_calibration(images(spark, sf, (2, 32)))[1]
    return found.select("vec_id", *[rnd(c).alias(c) for c in ("sigma", "least", "largest")])


@query("linalg_products_of_vectors", f"WITH {CX} SELECT a.vec_id, {R('sum(a.re * b.re - a.im * b.im)')} AS re, {R('sum(a.re * b.im + a.im * b.re)')} AS im, {R('sum(a.re * a.re + a.im * a.im)')} AS squared, {R('sqrt(sum(a.re * a.re + a.im * a.im))')} AS norm, {R('1.5 * sum(a.re)')} AS scaled FROM cx a JOIN cx b ON a.vec_id = b.vec_id AND b.i0 = 3 - a.i0 AND a.i1 = b.i1 GROUP BY 1")
def _(spark, sf):
    g = complex_images(spark, sf)
    out = linalg.dotu(g, arrays.reverse_rows(g)).join(catalog.LINALG["squared_norm"](g).withColumnRenamed("total", "squared"), "vec_id").join(catalog.LINALG["norm_l2"](g), "vec_id")
    out = out.join(linalg.scale(g, 1.5).df.groupBy("vec_id").agg(F.sum("re").alias("scaled")), "vec_id")
    return out.select("vec_id", *[rnd(c).alias(c) for c in ("re", "im", "squared", "norm", "scaled")])


@query("linalg_rotations_of_points", "SELECT n_nationkey AS k, round(0.8 * n_nationkey - 0.6 * n_regionkey, 6) + 0.0 AS z0, round(0.6 * n_nationkey + 0.8 * n_regionkey, 6) + 0.0 AS z1, round(0.8 * n_regionkey - 0.6, 6) + 0.0 AS x1, round(0.6 * n_regionkey + 0.8, 6) + 0.0 AS x2, round(0.8 * n_nationkey + 0.6, 6) + 0.0 AS y0, round(0.8 - 0.6 * n_nationkey, 6) + 0.0 AS y2, round(0.8 * n_nationkey + 0.6 * n_regionkey, 6) + 0.0 AS t0 FROM nation")
def _(spark, sf):
    """(key, region, 1) turned about each axis by the angle of (0.8, 0.6), and a point by a matrix from the right."""
    t, angle = table(spark, sf, "nation"), math.atan2(0.6, 0.8)
    point = (F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"), F.lit(1.0))
    about = {a: linalg.matrix_times_point(catalog.LINALG[f"rotation_{a}"](angle), *point) for a in "xyz"}
    turned = linalg.point_times_matrix(catalog.LINALG["rotation_z"](angle), *point)
    return t.select(F.col("n_nationkey").alias("k"), rnd(about["z"][0]).alias("z0"), rnd(about["z"][1]).alias("z1"), rnd(about["x"][1]).alias("x1"), rnd(about["x"][2]).alias("x2"), rnd(about["y"][0]).alias("y0"), rnd(about["y"][2]).alias("y2"), rnd(turned[0]).alias("t0"))


@query("linalg_downhill_simplex", "SELECT n_nationkey, i0::INT AS i0, CASE i0 WHEN 0 THEN 1.0 ELSE -0.5 END AS v FROM nation, range(2) r(i0)")
def _(spark, sf):
    """From each nation's point to the minimum of (x - 1)^2 + 2 (y + 0.5)^2."""
    t = table(spark, sf, "nation")
    start = t.select("n_nationkey", F.lit(0).alias("i0"), (F.col("n_nationkey") * 0.1).alias("v")).unionByName(t.select("n_nationkey", F.lit(1).alias("i0"), (F.col("n_regionkey") * 0.2).alias("v")))
    return shown(linalg.downhill_simplex(Grid(start, (2,), ("n_nationkey",)), lambda p: (p[0] - 1) ** 2 + 2 * (p[1] + 0.5) ** 2, [-5, -5], [5, 5]), 3)


# ---------------------------------------------------------------- images
def imagewise(name: str, f, sql: str, digits: int = 6) -> None:
    query(f"image_{name}", sql)(lambda spark, sf: shown(f(images(spark, sf)), digits))


_BOX = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _twice(first: str, then: str) -> str:
    inner = _near(first, _BOX, digits=12)
    rows = ", ".join(f"({a}, {b})" for a, b, _ in _BOX)
    return f"WITH e AS ({inner}) SELECT p.vec_id, p.i0, p.i1, {R(f'{then}(q.v)')} AS v FROM e p CROSS JOIN (VALUES {rows}) k(a, b) JOIN e q ON q.vec_id = p.vec_id AND q.i0 = least(greatest(p.i0 + a, 0), 7) AND q.i1 = least(greatest(p.i1 + b, 0), 7) GROUP BY 1, 2, 3"


imagewise("morph_open", lambda g: image.morph_open(g, image.box(3, 3)), _twice("min(v)", "max"))
imagewise("morph_close", lambda g: image.morph_close(g, image.box(3, 3)), _twice("max(v)", "min"))
imagewise("erode_mask", lambda g: image.erode_mask(g.map(lambda v: F.when(v > -0.1, 1.0).otherwise(0.0)), image.box(3, 3)), _near("min(CASE WHEN v > -0.1 THEN 1.0 ELSE 0.0 END)", _BOX, "constant").replace("coalesce(q.v, 0) AS v", "coalesce(q.v, -9) AS v"))
imagewise("erode_mask_in_place", lambda g: catalog.IMAGE["erode_mask_in_place"](g.map(lambda v: F.when(v > -0.1, 1.0).otherwise(0.0)), image.box(3, 3)), _near("min(CASE WHEN v > -0.1 THEN 1.0 ELSE 0.0 END)", _BOX, "constant").replace("coalesce(q.v, 0) AS v", "coalesce(q.v, -9) AS v"))
imagewise("filter2d_region", lambda g: image.filter2d_region(g, [[0.5, 1.0, -1.0], [2.0, 0.25, 0.0], [1.0, -2.0, 1.5]], (1, 2), (4, 5)), "WITH f AS (" + _near("sum(w * v)", [(-1, -1, 0.5), (-1, 0, 1.0), (-1, 1, -1.0), (0, -1, 2.0), (0, 0, 0.25), (0, 1, 0.0), (1, -1, 1.0), (1, 0, -2.0), (1, 1, 1.5)]) + ") SELECT vec_id, i0 - 1 AS i0, i1 - 2 AS i1, v FROM f WHERE i0 BETWEEN 1 AND 4 AND i1 BETWEEN 2 AND 6")
_G = [math.exp(-(d * d) / (2 * 0.64)) for d in (-1, 0, 1)]
_GAUSS = [(a, b, _G[a + 1] * _G[b + 1] / sum(_G) ** 2) for a in (-1, 0, 1) for b in (-1, 0, 1)]
imagewise("gaussian_blur_by_formula", lambda g: image.gaussian_blur(g, 3, 0.8), _near("sum(w * v)", _GAUSS))
imagewise("unsharp_mask_by_formula", lambda g: image.unsharp_mask(g, 1.5, 3, 0.8), _near("max(mid) + 1.5 * (max(mid) - sum(w * v))", _GAUSS))
_SX = [(-1, -1, -1.0), (-1, 1, 1.0), (0, -1, -2.0), (0, 1, 2.0), (1, -1, -1.0), (1, 1, 1.0)]
imagewise("sobel_x_by_weights", image.sobel_x, _near("sum(w * v)", _SX))
imagewise("sobel_y_by_weights", image.sobel_y, _near("sum(w * v)", [(b, a, w) for a, b, w in _SX]))
imagewise("laplacian_by_weights", image.laplacian, _near("sum(w * v)", [(-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (0, 0, -4.0)]))
imagewise("dilate_box_by_places", lambda g: image.dilate(g, image.box(3, 5)), _near("max(v)", [(a, b, 1.0) for a in (-1, 0, 1) for b in (-2, -1, 0, 1, 2)]))
imagewise("dilate_mask_disk_by_places", lambda g: catalog.IMAGE["dilate_mask_in_place"](g.map(lambda v: F.when(v > 0.15, 1.0).otherwise(0.0)), image.disk_structuring_element(2)), _near("max(CASE WHEN v > 0.15 THEN 1.0 ELSE 0.0 END)", [(a, b, 1.0) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4], "constant"))

_CUBIC = "CASE WHEN abs(x) <= 1 THEN 1.25 * pow(abs(x), 3) - 2.25 * x * x + 1 WHEN abs(x) < 2 THEN -0.75 * pow(abs(x), 3) + 3.75 * x * x - 6 * abs(x) + 3 ELSE 0 END"
_LINEAR = "greatest(0, 1 - abs(x))"
_SINC = f"CASE WHEN x = 0 THEN 1 WHEN abs(x) >= {{a}} THEN 0 ELSE sin({PI} * x) * sin({PI} * x / {{a}}) * {{a}} / ({PI} * {PI} * x * x) END"
_BSPLINE = "CASE WHEN abs(x) < 1 THEN (4 - 6 * x * x + 3 * pow(abs(x), 3)) / 6 WHEN abs(x) < 2 THEN pow(2 - abs(x), 3) / 6 ELSE 0 END"
_MITCHELL = "CASE WHEN abs(x) < 1 THEN (7 * pow(abs(x), 3) - 12 * x * x + 16.0 / 3) / 6 WHEN abs(x) < 2 THEN (-7.0 / 3 * pow(abs(x), 3) + 12 * x * x - 20 * abs(x) + 32.0 / 3) / 6 ELSE 0 END"


def _axis(name: str, n: int, m: int, weight: str, reach: int) -> str:
    """A table (o, i, w): the weights with which output o of m takes input i of n, ends on ends, the border repeated."""
    if weight == "nearest":
        return f"{name} AS (SELECT o::INT AS o, least(floor(o * {n - 1}.0 / {m - 1} + 0.5), {n - 1})::INT AS i, 1.0 AS w FROM range({m}) r(o))"
    if weight == "area":
        return f"{name} AS (SELECT o::INT AS o, i::INT AS i, (least((o + 1) * {n}.0 / {m}, i + 1) - greatest(o * {n}.0 / {m}, i)) / ({n}.0 / {m}) AS w FROM range({m}) r(o), range({n}) s(i) WHERE least((o + 1) * {n}.0 / {m}, i + 1) > greatest(o * {n}.0 / {m}, i))"
    raw = f"SELECT o, least(greatest(floor(o * {n - 1}.0 / {m - 1}) + k, 0), {n - 1})::INT AS i, o * {n - 1}.0 / {m - 1} - floor(o * {n - 1}.0 / {m - 1}) - k AS x FROM range({m}) r(o), range({1 - reach}, {reach + 1}) s(k)"
    return f"{name} AS (SELECT o::INT AS o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, sum({weight}) AS w FROM ({raw}) GROUP BY 1, 2))"


for _k, _w, _reach in (("nearest", "nearest", 0), ("linear", _LINEAR, 1), ("cubic", _CUBIC, 2), ("area", "area", 0), ("lanczos4", _SINC.format(a="4.0"), 4)):
    imagewise(f"resize_{_k}_by_formula", lambda g, k=_k: catalog.IMAGE[f"resize_{k}"](g, 5, 11), f"WITH {PX}, {_axis('a', 8, 5, _w, _reach)}, {_axis('b', 8, 11, _w, _reach)} SELECT vec_id, a.o AS i0, b.o AS i1, {R('sum(a.w * b.w * v)')} AS v FROM px JOIN a ON i0 = a.i JOIN b ON i1 = b.i GROUP BY 1, 2, 3")


@query("image_cubic_interpolate_2d", f"WITH {PX}, {_axis('a', 8, 13, _CUBIC, 2)} SELECT vec_id, a.o AS i0, i1, {R('sum(a.w * v)')} AS v FROM px JOIN a ON i0 = a.i GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(catalog.IMAGE["cubic_interpolate_2d_inplace"](images(spark, sf), 0, 13))


@query("image_resize_volume_cubic", f"WITH {CUBE}, {_axis('a', 4, 3, _CUBIC, 2)}, {_axis('b', 4, 5, _CUBIC, 2)}, {_axis('c', 4, 6, _CUBIC, 2)} SELECT vec_id, a.o AS i0, b.o AS i1, c.o AS i2, {R('sum(a.w * b.w * c.w * v)')} AS v FROM cb JOIN a ON i0 = a.i JOIN b ON i1 = b.i JOIN c ON i2 = c.i GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return shown(image.resize_volume_cubic(images(spark, sf, (4, 4, 4)), 3, 5, 6))


for _k, _w, _reach in (("linear", _LINEAR, 1), ("cubic", _CUBIC, 2), ("mitchell", _MITCHELL, 2), ("lanczos3", _SINC.format(a="3.0"), 3)):
    query(f"signal_resample_{_k}_by_formula", f"WITH {VX}, {_axis('a', 64, 40, _w, _reach)} SELECT vec_id, a.o AS i0, {R('sum(a.w * v)')} AS v FROM vx JOIN a ON i0 = a.i GROUP BY 1, 2")(lambda spark, sf, k=_k: shown(signal.resample(vectors(spark, sf), 40, k)))


def _rotated(weight: str, radians: float) -> str:
    c, s = repr(math.cos(radians)), repr(math.sin(radians))
    at = f"SELECT y::INT AS i0, x::INT AS i1, {c} * (y - 3.5) + {s} * (x - 3.5) + 3.5 AS sy, -{s} * (y - 3.5) + {c} * (x - 3.5) + 3.5 AS sx FROM range(8) a(y), range(8) b(x)"
    taps = f"SELECT i0, i1, (floor(sy) + p)::INT AS j0, (floor(sx) + q)::INT AS j1, sy - floor(sy) - p AS u, sx - floor(sx) - q AS t FROM ({at}), range(-1, 3) m(p), range(-1, 3) n(q)"
    weight_of = lambda v: weight.replace("x", v).replace("eVp", "exp").replace(f"ma{v}", "max")
    return f"WITH {PX}, w AS (SELECT i0, i1, j0, j1, ({weight_of('u')}) * ({weight_of('t')}) AS w FROM ({taps}) WHERE j0 BETWEEN 0 AND 7 AND j1 BETWEEN 0 AND 7) SELECT vec_id, w.i0, w.i1, {R('sum(w * v)')} AS v FROM w JOIN px ON px.i0 = j0 AND px.i1 = j1 GROUP BY 1, 2, 3"


imagewise("rotate_cubic_by_formula", lambda g: image.rotate_cubic(g, 0.3), _rotated(_CUBIC, 0.3))
imagewise("rotate_cubic_bspline_smooth", lambda g: image.rotate_cubic_bspline_smooth(g, 0.3), _rotated(_BSPLINE, 0.3))
_PARTS = f"RECURSIVE {PX}, m AS (SELECT vec_id, i0, i1 FROM px WHERE v > 0.05), r AS (SELECT vec_id, i0, i1, i0 * 8 + i1 AS root FROM m UNION SELECT p.vec_id, p.i0, p.i1, r.root FROM r JOIN m p ON p.vec_id = r.vec_id AND abs(p.i0 - r.i0) + abs(p.i1 - r.i1) = 1 WHERE r.root < p.i0 * 8 + p.i1), l AS (SELECT vec_id, i0, i1, min(root) AS root FROM r GROUP BY 1, 2, 3), n AS (SELECT vec_id, root, count(*) AS n FROM l GROUP BY 1, 2), best AS (SELECT vec_id, arg_min(root, (-n, root)) AS root FROM n GROUP BY 1)"
imagewise("largest_component", lambda g: image.keep_largest_component(g.map(lambda v: F.when(v > 0.05, 1.0).otherwise(0.0))), f"WITH {_PARTS} SELECT px.vec_id, px.i0, px.i1, CASE WHEN best.root IS NULL THEN 0.0 ELSE 1.0 END AS v FROM px LEFT JOIN l USING (vec_id, i0, i1) LEFT JOIN best ON best.vec_id = px.vec_id AND best.root = l.root")
imagewise("bm3d_without_noise", lambda g: image.bm3d_denoise_magnitude(g, 0.0), f"WITH {PX} SELECT vec_id, i0, i1, {R('v')} AS v FROM px")


@query("image_align_of_equal_images", f"WITH {PX} SELECT DISTINCT vec_id, k::INT AS i0, 0.0 AS v FROM px, range(3) r(k)")
def _(spark, sf):
    """Angle and shifts of an image to itself; a shifted one is in the tests."""
    g = images(spark, sf)
    return shown(image.align_ecc_euclidean(g, arrays.copy(g)))


@query("image_filter3d", f"WITH {CUBE} SELECT p.vec_id, p.i0, p.i1, p.i2, {R('sum((0.5 * a - b + 0.25 * c) * q.v)')} AS v FROM cb p CROSS JOIN range(-1, 2) x(a) CROSS JOIN range(-1, 2) y(b) CROSS JOIN range(-1, 2) z(c) JOIN cb q ON q.vec_id = p.vec_id AND q.i0 = least(greatest(p.i0 + a, 0), 3) AND q.i1 = least(greatest(p.i1 + b, 0), 3) AND q.i2 = least(greatest(p.i2 + c, 0), 3) GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    k = [[[0.5 * a - b + 0.25 * c for c in (-1, 0, 1)] for b in (-1, 0, 1)] for a in (-1, 0, 1)]
    return shown(catalog.IMAGE["filter3d_replicate_in_place"](images(spark, sf, (4, 4, 4)), np.array(k)))


_DRAWN = "SELECT y::INT AS i0, x::INT AS i1, CASE WHEN y = x AND y BETWEEN 8 AND 11 THEN 5 WHEN (y IN (2, 6) AND x BETWEEN 9 AND 13) OR (x IN (9, 13) AND y BETWEEN 2 AND 6) THEN 7 WHEN (y - 4) * (y - 4) + (x - 4) * (x - 4) <= 9 THEN 3 ELSE 1 END AS blue FROM range(12) a(y), range(16) b(x)"


@query("image_drawing", _DRAWN)
def _(spark, sf):
    """A filled circle, a closed frame and a slanted line on a filled picture."""
    from tessera.operators import raster

    picture = raster.fill_bgr(raster.make_bgr_image(12, 16), (1, 0, 0))
    raster.draw_circle(picture, (4, 4), 3, (3, 0, 0), filled=True)
    raster.draw_polyline(picture, [(2, 9), (2, 13), (6, 13), (6, 9)], (7, 0, 0), closed=True)
    raster.draw_line(picture, (8, 8), (11, 11), (5, 0, 0))
    return spark.createDataFrame([(y, x, int(picture[y, x, 0])) for y in range(12) for x in range(16)], "i0 int, i1 int, blue int")


_OTSU3 = f"""RECURSIVE {CUBE}, e AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM cb GROUP BY 1),
h AS (SELECT vec_id, lo, hi, floor((v - lo) * (255.0 / (hi - lo)))::INT AS bin, count(*) AS n FROM cb JOIN e USING (vec_id) WHERE hi > lo GROUP BY 1, 2, 3, 4),
c AS (SELECT *, sum(n) OVER r AS w0, sum(n * bin) OVER r AS s0, sum(n) OVER a AS wn, sum(n * bin) OVER a AS sn FROM h WINDOW r AS (PARTITION BY vec_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY vec_id)),
b AS (SELECT vec_id, lo, hi, bin, w0::DOUBLE * (wn - w0) * (s0::DOUBLE / w0 - (sn - s0)::DOUBLE / (wn - w0)) * (s0::DOUBLE / w0 - (sn - s0)::DOUBLE / (wn - w0)) AS between_ FROM c WHERE wn > w0),
t AS (SELECT vec_id, lo + arg_min(bin, (-between_, bin)) / (255.0 / (hi - lo)) AS threshold FROM b GROUP BY vec_id, lo, hi),
m AS (SELECT vec_id, i0, i1, i2, i0 * 16 + i1 * 4 + i2 AS place FROM cb JOIN t USING (vec_id) WHERE v > threshold),
r AS (SELECT vec_id, i0, i1, i2, place AS root FROM m UNION SELECT p.vec_id, p.i0, p.i1, p.i2, r.root FROM r JOIN m p ON p.vec_id = r.vec_id AND abs(p.i0 - r.i0) + abs(p.i1 - r.i1) + abs(p.i2 - r.i2) = 1 WHERE r.root < p.place),
l AS (SELECT vec_id, i0, i1, i2, min(root) AS root FROM r GROUP BY 1, 2, 3, 4), n AS (SELECT vec_id, root, count(*) AS n FROM l GROUP BY 1, 2), best AS (SELECT vec_id, arg_min(root, (-n, root)) AS root FROM n GROUP BY 1),
body AS (SELECT l.vec_id, i0, i1, i2 FROM l JOIN best USING (vec_id, root)), rest AS (SELECT vec_id, i0, i1, i2 FROM cb ANTI JOIN body USING (vec_id, i0, i1, i2)),
o AS (SELECT vec_id, i0, i1, i2 FROM rest WHERE i0 IN (0, 3) OR i1 IN (0, 3) OR i2 IN (0, 3) UNION SELECT p.vec_id, p.i0, p.i1, p.i2 FROM o JOIN rest p ON p.vec_id = o.vec_id AND abs(p.i0 - o.i0) + abs(p.i1 - o.i1) + abs(p.i2 - o.i2) = 1)"""


@query("image_volume_foreground", f"WITH {_OTSU3} SELECT cb.vec_id, cb.i0, cb.i1, cb.i2, CASE WHEN o.i0 IS NULL THEN 1.0 ELSE 0.0 END AS v FROM cb LEFT JOIN o USING (vec_id, i0, i1, i2)")
def _(spark, sf):
    return image.calculate_volume_foreground_mask(images(spark, sf, (4, 4, 4))).df


# ---------------------------------------------------------------- special functions, by series and integrals in SQL
def special_by(name: str, f, sql: str) -> None:
    query(f"special_{name}", f"WITH {PX} SELECT vec_id, i0, i1, {R(sql)} AS v FROM (SELECT vec_id, i0, i1, v * 3 AS x FROM px)")(lambda spark, sf: shown(images(spark, sf).map(lambda v: f(v * 3.0))))


_ERF = f"(2 / sqrt({PI}) * list_sum(list_transform(range(40), lambda k: CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))))"
_BESSEL = f"list_sum(list_transform(range(64), lambda k: cos({{n}} * (k + 0.5) * {PI} / 64 - x * sin((k + 0.5) * {PI} / 64)))) / 64"
special_by("erf", special.erf, _ERF)
special_by("erfc", special.erfc, f"1 - {_ERF}")
special_by("cdf_norm", special.cdf_norm, f"0.5 + 0.5 * {_ERF.replace('pow(x,', 'pow(x / sqrt(2.0),')}")
special_by("cdfnorm", special.cdfnorm, f"0.5 + 0.5 * {_ERF.replace('pow(x,', 'pow(x / sqrt(2.0),')}")
special_by("bessel_i0", special.bessel_i0, "list_sum(list_transform(range(30), lambda k: pow(x * x / 4, k) / pow(gamma(k + 1), 2)))")
special_by("bessel_j0", special.bessel_j0, _BESSEL.format(n=0))
special_by("bessel_j1", special.bessel_j1, _BESSEL.format(n=1))
special_by("bessel_j5", lambda x: special.bessel_j(5, x * 10.0), _BESSEL.format(n=5).replace("- x *", "- 10 * x *"))


# ---------------------------------------------------------------- signals
@query("signal_fir_causal", f"WITH {VX} SELECT a.vec_id, a.i0, {R('sum(b.v * w)')} AS v FROM vx a CROSS JOIN (VALUES (0, 0.5), (1, 0.3), (2, 0.2)) t(k, w) JOIN vx b ON b.vec_id = a.vec_id AND b.i0 = a.i0 - k GROUP BY 1, 2")
def _(spark, sf):
    return shown(signal.fir_filter(vectors(spark, sf), [0.5, 0.3, 0.2]))


_K4 = [(a, b, w) for a, row in enumerate([[1.0, 2.0, 0.5], [-1.0, 3.0, 1.0], [0.0, 1.0, 2.0]]) for b, w in enumerate(row)]
_TABLE = ", ".join(f"({a - 1}, {b - 1}, {w!r}::DOUBLE)" for a, b, w in _K4)


def _zeroed(sign: str) -> str:
    return f"WITH {PX} SELECT p.vec_id, p.i0, p.i1, {R('sum(w * q.v)')} AS v FROM px p CROSS JOIN (VALUES {_TABLE}) k(a, b, w) JOIN px q ON q.vec_id = p.vec_id AND q.i0 = p.i0 {sign} a AND q.i1 = p.i1 {sign} b GROUP BY 1, 2, 3"


query("signal_correlate2d_same", _zeroed("+"))(lambda spark, sf: shown(signal.correlate2d_same(images(spark, sf), _K3)))
query("signal_convolve2d_same", _zeroed("-"))(lambda spark, sf: shown(signal.convolve2d_same(images(spark, sf), _K3)))
query("signal_correlate2d_same_fft", _zeroed("+"))(lambda spark, sf: shown(catalog.SIGNAL["correlate2d_same_fft"](images(spark, sf), _K3)))


@query("signal_separable", f"WITH {PX} SELECT p.vec_id, p.i0, p.i1, {R('sum((2 * a * a - a + 1) * (0.5 + b) * q.v)')} AS passes, {R('sum((2 * a * a - a + 1) * (0.5 + b) * q.v)')} AS composed FROM px p CROSS JOIN range(-1, 2) x(a) CROSS JOIN range(-1, 2) y(b) JOIN px q ON q.vec_id = p.vec_id AND q.i0 = p.i0 + a AND q.i1 = p.i1 + b GROUP BY 1, 2, 3")
def _(spark, sf):
    row, col = [4.0, 1.0, 2.0], [-0.5, 0.5, 1.5]
    g = images(spark, sf)
    return joined({"passes": shown(signal.correlate2d_same_separable(g, row, col)), "composed": shown(signal.correlate2d_same(g, signal.compose_separable_kernel(row, col)))}, ["vec_id", "i0", "i1"])


@query("signal_normal_equation", f"WITH {PX} SELECT vec_id, i0 - (i0 > 3)::INT AS i0, i1 - (i1 > 3)::INT AS i1, {R('v')} AS v FROM px WHERE i0 <> 3 AND i1 <> 3 UNION ALL SELECT vec_id, i0 - (i0 > 3)::INT, -1, {R('v')} FROM px WHERE i0 <> 3 AND i1 = 3")
def _(spark, sf):
    """The matrix without its fourth row and column, and as column -1 what that column had."""
    inner, rhs = signal.normal_equation_without_index(images(spark, sf), 3)
    return shown(inner).union(rhs.df.select("vec_id", "i0", F.lit(-1).alias("i1"), rnd("v").alias("v")))


@query("signal_unwrap_phase_of_vectors", f"WITH {VX}, p AS (SELECT vec_id, i0, v * 20 AS v FROM vx), d AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY i0) AS s FROM p) SELECT vec_id, i0, {R(f'v + {2 * math.pi!r} * sum(CASE WHEN s > {PI} THEN -1 WHEN s < -{PI} THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i0)')} AS v FROM d")
def _(spark, sf):
    return shown(signal.unwrap_phase(vectors(spark, sf).map(lambda v: v * 20.0)))


@query("signal_unwrap_phase_laplacian", f"WITH {PX} SELECT vec_id, i0, i1, {R('v + 0.4 * i0 - 0.7 * i1')} AS v FROM px")
def _(spark, sf):
    """Wrapped phases whose true steps are under half a turn come back as they were."""
    g = images(spark, sf).map(lambda v: v + F.col("i0") * 0.4 - F.col("i1") * 0.7)
    return shown(signal.unwrap_phase_laplacian_2d(signal.wrap_phase(g)))


@query("window_cosine_laplacian", f"SELECT (i // 8)::INT AS i0, (i % 8)::INT AS i1, {R(f'2 * (cos({PI} * (i // 8) / 8) + cos({PI} * (i % 8) / 8) - 2)')} AS v FROM range(64) r(i)")
def _(spark, sf):
    return shown(constants(spark, (8, 8), lambda lin, i, j: win.cosine_laplacian_denominator(i.cast("double"), j.cast("double"), 8)))


@query("window_of_signal", f"SELECT k AS name, i::INT AS i0, {R(f'CASE k WHEN {chr(39)}hann{chr(39)} THEN 0.5 - 0.5 * cos(2 * {PI} * i / 31) ELSE 0.54 - 0.46 * cos(2 * {PI} * i / 31) END', 9)} AS v FROM range(32) r(i), (VALUES ('hann'), ('hamming')) n(k)")
def _(spark, sf):
    a, b = (shown(signal.window(spark, 32, k), 9).select(F.lit(k).alias("name"), "i0", "v") for k in ("hann", "hamming"))
    return a.union(b)


# ---------------------------------------------------------------- non-uniform Fourier and sparse
_RAD = "r AS (SELECT s, 0.9 * s * cos(0.7 * s) / 16 AS kr, 0.9 * s * sin(0.7 * s) / 16 AS kc FROM range(32) q(s))"


def spiral(spark, n: int = 32) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("sample"), (F.col("id") * 0.9 * F.cos(F.col("id") * 0.7) / 16).alias("k_row"), (F.col("id") * 0.9 * F.sin(F.col("id") * 0.7) / 16).alias("k_col"))


@query("nufft_ramp", f"WITH {_RAD} SELECT s::INT AS sample, {R('0.9 * s / 16')} AS w FROM r")
def _(spark, sf):
    return spiral(spark).select("sample", rnd(nufft.radial_analytic_ramp_dcf2(F.col("k_row"), F.col("k_col"))).alias("w"))


def _gridded(channels: int) -> str:
    """Ramp-weighted linear gridding on 4 x 8 and the sum over its points, of each channel's share of the 32 samples."""
    n = 32 // channels
    return f"""WITH {_RAD}, d AS (SELECT vec_id, c, s, embedding[c * {n} + s + 1]::DOUBLE AS re, embedding[c * {n} + s + 33]::DOUBLE AS im FROM embeddings, range({channels}) x(c), range({n}) y(s)),
p AS (SELECT vec_id, c, kr * 4 / {2 * math.pi!r} AS pr, kc * 8 / {2 * math.pi!r} AS pc, -(kr * 1.5 + kc * 3.5) AS t, sqrt(kr * kr + kc * kc) AS w, re, im FROM d JOIN r USING (s)),
z AS (SELECT vec_id, c, pr, pc, w * (re * cos(t) - im * sin(t)) AS zr, w * (re * sin(t) + im * cos(t)) AS zi FROM p),
g AS (SELECT vec_id, c, ((floor(pr)::INT + a) % 4 + 4) % 4 AS fr, ((floor(pc)::INT + b) % 8 + 8) % 8 AS fc, (CASE a WHEN 1 THEN pr - floor(pr) ELSE 1 - pr + floor(pr) END) * (CASE b WHEN 1 THEN pc - floor(pc) ELSE 1 - pc + floor(pc) END) AS u, zr, zi FROM z, range(2) i(a), range(2) j(b)),
h AS (SELECT vec_id, c, fr, fc, sum(u * zr) AS zr, sum(u * zi) AS zi FROM g GROUP BY 1, 2, 3, 4),
e AS (SELECT vec_id, c, i0::INT AS i0, i1::INT AS i1, zr, zi, {2 * math.pi!r} * (fr * i0 / 4.0 + fc * i1 / 8.0) AS t FROM h, range(4) a(i0), range(8) b(i1))"""


@query("nufft_radial_gridding", f"{_gridded(1)} SELECT vec_id, i0, i1, {R('sum(zr * cos(t) - zi * sin(t))')} AS re, {R('sum(zr * sin(t) + zi * cos(t))')} AS im FROM e GROUP BY 1, 2, 3")
def _(spark, sf):
    s = complex_images(spark, sf, (32,)).df.withColumnRenamed("i0", "sample").join(spiral(spark), "sample")
    return shown(nufft.radial_linear_gridding2_adjoint(s, ("vec_id",), 4, 8))


@query("recon_radial_gridding", f"{_gridded(2)} SELECT vec_id, i0, i1, c::INT AS i2, {R('sum(zr * cos(t) - zi * sin(t))')} AS re, {R('sum(zr * sin(t) + zi * cos(t))')} AS im FROM e GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return shown(recon.radial_gridding_reconstruct(complex_images(spark, sf, (2, 16)), spiral(spark, 16), 4, 8))


@query("sparse_conversions", "SELECT l_partkey AS \"row\", l_orderkey AS col, sum(l_quantity) AS v, 7 AS \"rows\", 3 AS cols, 3 AS same_rows FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    """The transpose by columns, dealt as a plan for products deals it, and the sizes of operations."""
    coo = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("v"))
    planned = catalog.SPARSE["make_csr_plan"](sparse.compact(sparse.convert_csr(coo, "transpose")), 4)
    return planned.select("row", "col", "v", F.lit(sparse.operation_rows(3, 7, "transpose")).alias("rows"), F.lit(sparse.operation_cols(3, 7, "transpose")).alias("cols"), F.lit(sparse.operation_rows(3, 7, "none")).alias("same_rows"))


# ---------------------------------------------------------------- reconstruction
def constant_matrix(spark, *rows: tuple[complex, ...]) -> Grid:
    """A keyless complex matrix of given entries."""
    df = spark.createDataFrame([(i, j, complex(z).real, complex(z).imag) for i, row in enumerate(rows) for j, z in enumerate(row)], "i0 int, i1 int, re double, im double")
    return Grid(df, (len(rows), len(rows[0])), (), True)


#: Two channels of 4 x 4 points, and of 16 samples.
C2 = "k2 AS (SELECT vec_id, (i // 4)::INT AS i1, (i % 4)::INT AS i2, i::INT AS n, embedding[i + 1]::DOUBLE AS ar, embedding[i + 33]::DOUBLE AS ai, embedding[i + 17]::DOUBLE AS br, embedding[i + 49]::DOUBLE AS bi FROM embeddings, range(16) r(i))"
_WHITE = ((2.0, 0.5j), (0.25, 1.0 - 1.0j))
_W0 = ("2 * ar - 0.5 * bi", "2 * ai + 0.5 * br")
_W1 = ("0.25 * ar + br + bi", "0.25 * ai + bi - br")


@query("recon_prewhitened_lines", f"WITH {C2} SELECT vec_id, 0 AS i0, i1, i2, {R(_W0[0])} AS re, {R(_W0[1])} AS im FROM k2 UNION ALL SELECT vec_id, 1, i1, i2, {R(_W1[0])}, {R(_W1[1])} FROM k2")
def _(spark, sf):
    return shown(recon.noise_prewhiten(complex_images(spark, sf, (2, 4, 4)), constant_matrix(spark, *_WHITE)))


@query("recon_prewhitened_samples", f"WITH {C2} SELECT vec_id, 0 AS i0, n AS i1, {R(_W0[0])} AS re, {R(_W0[1])} AS im FROM k2 UNION ALL SELECT vec_id, 1, n, {R(_W1[0])}, {R(_W1[1])} FROM k2")
def _(spark, sf):
    return shown(recon.noncartesian_noise_prewhiten(complex_images(spark, sf, (2, 16)), constant_matrix(spark, *_WHITE)))


@query("recon_compressed_lines", f"WITH {C2} SELECT vec_id, 0 AS i0, i1, i2, {R('0.6 * ar + 0.8 * bi')} AS re, {R('0.6 * ai - 0.8 * br')} AS im FROM k2")
def _(spark, sf):
    return shown(recon.coil_compress(complex_images(spark, sf, (2, 4, 4)), constant_matrix(spark, (0.6, -0.8j))))


@query("recon_compressed_samples", f"WITH {C2} SELECT vec_id, 0 AS i0, n AS i1, {R('0.6 * ar + 0.8 * bi')} AS re, {R('0.6 * ai - 0.8 * br')} AS im FROM k2")
def _(spark, sf):
    return shown(recon.noncartesian_coil_compress(complex_images(spark, sf, (2, 16)), constant_matrix(spark, (0.6, -0.8j))))


@query("recon_compressed_strongest", f"""WITH {C2}, c AS (SELECT vec_id, sum(ar * ar + ai * ai) / 16 AS x, sum(br * br + bi * bi) / 16 AS z, sum(ar * br + ai * bi) / 16 AS cr, sum(ai * br - ar * bi) / 16 AS ci FROM k2 GROUP BY 1)
SELECT vec_id, {R('16 * ((x + z) / 2 + sqrt((x - z) * (x - z) / 4 + cr * cr + ci * ci))')} AS energy FROM c""")
def _(spark, sf):
    """One virtual channel holds as much as the largest eigenvalue of the channels' covariance: no other basis does."""
    k = complex_images(spark, sf, (2, 4, 4))
    one = recon.coil_compress(k, recon.coil_compression_basis_estimate(k, 1))
    return one.df.groupBy("vec_id").agg(rnd(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("energy"))


@query("recon_noise_model", f"""WITH {C2}, m AS (SELECT vec_id, avg(ar) AS p, avg(ai) AS q, avg(br) AS r, avg(bi) AS s FROM k2 GROUP BY 1),
c AS (SELECT vec_id, avg((ar - p) ** 2 + (ai - q) ** 2) AS x, avg((br - r) ** 2 + (bi - s) ** 2) AS z, avg((ar - p) * (br - r) + (ai - q) * (bi - s)) AS yr, avg((ar - p) * (bi - s) - (ai - q) * (br - r)) AS yi FROM k2 JOIN m USING (vec_id) GROUP BY 1),
h AS (SELECT *, sqrt(x * z - yr * yr - yi * yi) AS d, sqrt(x + z + 2 * sqrt(x * z - yr * yr - yi * yi)) AS t FROM c)
SELECT vec_id, 0 AS i0, 0 AS i1, {R('(z + d) / (d * t)', 4)} AS re, 0.0 AS im FROM h UNION ALL SELECT vec_id, 0, 1, {R('-yr / (d * t)', 4)}, {R('-yi / (d * t)', 4)} FROM h UNION ALL SELECT vec_id, 1, 0, {R('-yr / (d * t)', 4)}, {R('yi / (d * t)', 4)} FROM h UNION ALL SELECT vec_id, 1, 1, {R('(x + d) / (d * t)', 4)}, 0.0 FROM h""")
def _(spark, sf):
    """The inverse square root of the channels' covariance, entry by entry."""
    return shown(recon.noise_model_estimate(complex_images(spark, sf, (2, 16))), 4)


@query("recon_phase_corrected_samples", f"""WITH q AS (SELECT vec_id, (i // 16)::INT AS c, ((i // 8) % 2)::INT AS l, (i % 8)::INT AS s, embedding[i + 1]::DOUBLE AS re, embedding[i + 33]::DOUBLE AS im FROM embeddings, range(32) r(i)),
p AS (SELECT vec_id, c, s, sum(re) / sqrt(sum(re) ** 2 + sum(im) ** 2) AS a, -sum(im) / sqrt(sum(re) ** 2 + sum(im) ** 2) AS b FROM q GROUP BY 1, 2, 3)
SELECT vec_id, c AS i0, s AS i1, {R('a * re - b * im')} AS re, {R('a * im + b * re')} AS im FROM q JOIN p USING (vec_id, c, s) WHERE l = 0 UNION ALL SELECT vec_id, c + 2, s, {R('a * re - b * im')}, {R('a * im + b * re')} FROM q JOIN p USING (vec_id, c, s) WHERE l = 1""")
def _(spark, sf):
    """Both lines of samples by the phasors of their sums over lines; the second line as channels 2 and 3."""
    reference = complex_images(spark, sf, (2, 2, 8))
    model, out = recon.noncartesian_phase_correction_estimate(reference), None
    for line in (0, 1):
        part = shown(recon.noncartesian_phase_correct(arrays.select_index(reference, 1, line), model)).withColumn("i0", F.col("i0") + 2 * line)
        out = part if out is None else out.union(part)
    return out


@query("recon_grappa_weights_applied", f"""WITH q AS (SELECT vec_id, (i // 16)::INT AS c, ((i // 4) % 4)::INT AS y, (i % 4)::INT AS x, embedding[i + 1]::DOUBLE AS re, embedding[i + 33]::DOUBLE AS im FROM embeddings, range(32) r(i))
SELECT vec_id, c AS i0, y AS i1, x AS i2, {R('re')} AS re, {R('im')} AS im FROM q WHERE y % 2 = 0 UNION ALL
SELECT vec_id, t::INT, ((y - 2 * n + 1 + 4) % 4)::INT, x, {R('sum(((n * 2 + c + 1) * 0.1 + t * 0.01) * re)')}, {R('sum(((n * 2 + c + 1) * 0.1 + t * 0.01) * im)')} FROM q, range(2) a(n), range(2) b(t) WHERE y % 2 = 0 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    """Every other line from two lines around, with given weights."""
    weights = spark.createDataFrame([(0, s, t, (s + 1) * 0.1 + t * 0.01, 0.0) for s in range(4) for t in range(2)], "i0 int, i1 int, i2 int, re double, im double")
    return shown(recon.cartesian_grappa_reconstruct(complex_images(spark, sf, (2, 4, 4)), Grid(weights, (1, 4, 2), (), True), 2, 1, 2))


_WAVE = "(embedding[x + {o}]::DOUBLE * cos(" + PI + " * y / 4) + embedding[x + {o} + 16]::DOUBLE * sin(" + PI + " * y / 4))"


@query("recon_grappa_calibrated", f"SELECT vec_id, 0 AS i0, y::INT AS i1, x::INT AS i2, {R(_WAVE.format(o=1), 4)} AS re, {R(_WAVE.format(o=33), 4)} AS im FROM embeddings, range(8) a(y), range(16) b(x)")
def _(spark, sf):
    """Columns that are one wave along the lines: each line is the same weighted sum of the two around it. Calibration finds
    the weights, and the lines that they fill in are the ones left out."""
    g = complex_images(spark, sf, (2, 16)).df.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    wave = F.when(F.col("i0") == 0, F.cos(F.col("y") * F.lit(math.pi / 4))).otherwise(F.sin(F.col("y") * F.lit(math.pi / 4)))
    df = g.groupBy("vec_id", F.col("y").alias("i1"), F.col("i1").alias("i2")).agg(F.sum(wave * F.col("re")).alias("re"), F.sum(wave * F.col("im")).alias("im")).withColumn("i0", F.lit(0))
    k = Grid(df.select("vec_id", "i0", "i1", "i2", "re", "im"), (1, 8, 16), ("vec_id",), True)
    return shown(recon.cartesian_grappa_reconstruct(k, recon.cartesian_grappa_kernel_calibrate(k, 2, 1, 2, 1e-12), 2, 1, 2), 4)


@query("recon_sense_unfolded", f"WITH {CX} SELECT vec_id, i0, i1, {R('re')} AS re, {R('im')} AS im FROM cx")
def _(spark, sf):
    """Rows folded on each other, seen by one coil as their sum and by another as their difference."""
    g = complex_images(spark, sf)
    folded = g.df.withColumn("sign", F.when(F.col("i0") < 2, 1.0).otherwise(-1.0)).withColumn("i0", F.col("i0") % 2)
    seen = folded.groupBy("vec_id", "i0", "i1").agg(F.sum("re").alias("a"), F.sum("im").alias("b"), F.sum(F.col("sign") * F.col("re")).alias("c"), F.sum(F.col("sign") * F.col("im")).alias("d"))
    coil = seen.select("vec_id", "i0", "i1", F.explode(F.array(F.struct(F.lit(0).alias("i2"), F.col("a").alias("re"), F.col("b").alias("im")), F.struct(F.lit(1).alias("i2"), F.col("c").alias("re"), F.col("d").alias("im")))).alias("z")).select("vec_id", "i0", "i1", "z.*")
    maps = constants(spark, (4, 8, 2), lambda lin, i, j, c: (F.when((c == 0) | (i < 2), 1.0).otherwise(-1.0), F.lit(0.0)))
    return shown(recon.cartesian_sense_reconstruct(Grid(coil, (2, 8, 2), ("vec_id",), True), maps, 2))


@query("recon_noncartesian_sense", f"WITH {CX} SELECT vec_id, i0, i1, {R('re', 5)} AS re, {R('im', 5)} AS im FROM cx")
def _(spark, sf):
    """Images seen at all points of their own Cartesian grid by one even coil come back."""
    g = complex_images(spark, sf)
    t = spark.range(32).select(F.col("id").cast("int").alias("sample"), (F.floor(F.col("id") / 8) * F.lit(2 * math.pi / 4)).alias("k_row"), (F.col("id") % 8 * F.lit(2 * math.pi / 8)).alias("k_col"))
    seen = nufft.forward(g, t).select("vec_id", F.lit(0).alias("i0"), F.col("sample").alias("i1"), "re", "im")
    maps = g.df.select("vec_id", "i0", "i1", F.lit(0).alias("i2"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return shown(recon.noncartesian_sense_reconstruct(Grid(seen, (1, 32), ("vec_id",), True), t, Grid(maps, (4, 8, 1), ("vec_id",), True), 4), 5)


@query("recon_trajectory_corrected", f"WITH {_RAD} SELECT s::INT AS sample, {R('kr * 1.1 + 0.01')} AS k_row, {R('kc * 0.9 - 0.02')} AS k_col FROM r")
def _(spark, sf):
    return recon.trajectory_correction(spiral(spark), 1.1, 0.9, 0.01, -0.02).select("sample", rnd("k_row").alias("k_row"), rnd("k_col").alias("k_col"))


@query("recon_image_parts", f"WITH {CX} SELECT vec_id, i0 - 1 AS i0, i1 - 2 AS i1, {R(_M)} AS magnitude, {R('atan2(im, re)')} AS phase FROM cx WHERE i0 BETWEEN 1 AND 2 AND i1 BETWEEN 2 AND 6")
def _(spark, sf):
    g = complex_images(spark, sf)
    crop = lambda x: shown(recon.image_crop_float32(x, 1, 2, 2, 5))
    return joined({"magnitude": crop(recon.image_magnitude_float32(g)), "phase": crop(recon.image_phase_float32(g))}, ["vec_id", "i0", "i1"])


@query("recon_image_steps", f"WITH {PX} SELECT vec_id, i0, i1, {R('v * 3')} AS scaled, {R('v + 0.1')} AS shifted, {R('greatest(least(v, 0.1), -0.2)')} AS clamped, {R('v / max(v) OVER (PARTITION BY vec_id)')} AS by_largest FROM px")
def _(spark, sf):
    g = images(spark, sf)
    made = {"scaled": recon.image_scale_float32(g, 3.0), "shifted": recon.image_offset_float32(g, 0.1), "clamped": recon.image_clamp_float32(g, -0.2, 0.1), "by_largest": recon.image_normalize(g, "max")}
    return joined({n: shown(m) for n, m in made.items()}, ["vec_id", "i0", "i1"])


@query("recon_image_nonfinite", f"WITH {PX} SELECT vec_id, count(*) FILTER (v > 0.2 OR v < -0.2) AS nonfinite, count(*) AS pixels FROM px GROUP BY 1")
def _(spark, sf):
    g = images(spark, sf).map(lambda v: F.when(v > 0.2, F.lit(float("nan"))).when(v < -0.2, F.lit(float("inf"))).otherwise(v))
    return recon.image_nonfinite_check(g)["report"]


@query("recon_sensitivity_maps", f"WITH {CX}, {CH}, s AS (SELECT label, i0, i1, sqrt(sum(re * re + im * im)) AS m FROM cx GROUP BY 1, 2, 3) SELECT cx.label, cx.i0, cx.i1, ch.channel AS i2, {R('re / m')} AS re, {R('im / m')} AS im FROM cx JOIN ch USING (vec_id) JOIN s ON s.label = cx.label AND s.i0 = cx.i0 AND s.i1 = cx.i1")
def _(spark, sf):
    df = coils(spark, sf).select("label", "i0", "i1", F.col("channel").alias("i2"), "re", "im")
    return shown(recon.sensitivity_map_estimate(Grid(df, (4, 8, 1 << 16), ("label",), True)))


# ---------------------------------------------------------------- records
def records(spark, sf) -> DataFrame:
    """An acquisition from each line item: as many samples as its line number says, in one channel; some break a rule."""
    n = F.col("l_linenumber")
    size = F.when(F.col("l_quantity") > 45, n + 1).otherwise(n)
    sample = F.struct(F.when(F.col("l_quantity") == 1, F.lit(float("nan"))).otherwise(F.lit(1.0)).cast("float").alias("re"), F.lit(0.0).cast("float").alias("im"))
    flags = F.when(F.col("l_returnflag") == "R", F.lit(1 << 21)).when(F.col("l_linestatus") == "O", F.lit(1 << 18)).otherwise(F.lit(3)).cast("long")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", n.alias("number_of_samples"), F.lit(1).alias("active_channels"), F.lit(1).alias("available_channels"), F.lit(0).alias("trajectory_dimensions"), F.lit(0).alias("discard_pre"), F.lit(0).alias("discard_post"),
        F.when(F.col("l_quantity") == 2, n).otherwise(F.lit(0)).alias("center_sample"), F.array_repeat(sample, size).alias("samples"), F.array().cast("array<float>").alias("trajectory"), flags.alias("flags"),
    )


_WHY = "CASE WHEN l_quantity > 45 THEN 'samples' WHEN l_quantity = 2 THEN 'center' WHEN l_quantity = 1 THEN 'nonfinite' END"


@query("ingest_layout_errors", f"SELECT l_orderkey, l_linenumber, {_WHY} AS error, l_returnflag = 'R' AS unsupported FROM lineitem")
def _(spark, sf):
    return records(spark, sf).select("l_orderkey", "l_linenumber", ingest.layout_error().alias("error"), ingest.unsupported_flags(F.col("flags")).alias("unsupported"))


@query("ingest_quarantined", f"SELECT coalesce({_WHY}, 'flags') AS reason, count(*) AS n FROM lineitem WHERE {_WHY} IS NOT NULL OR l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT 'passed', count(*) FROM lineitem WHERE {_WHY} IS NULL AND l_returnflag <> 'R'")
def _(spark, sf):
    good, bad = ingest.quarantine(records(spark, sf))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).union(good.agg(F.lit("passed").alias("reason"), F.count("*").alias("n")).select("reason", "n"))


@query("ingest_admitted_lanes", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'noise' ELSE 'imaging' END AS lane, l_linestatus <> 'O' AS first_in_encode_step_1, l_linestatus <> 'O' AS last_in_encode_step_1, false AS first_in_slice FROM lineitem WHERE {_WHY} IS NULL AND l_returnflag <> 'R'")
def _(spark, sf):
    """Records that break no rule, by lane, with their control flags."""
    good, _ = ingest.quarantine(records(spark, sf))
    df = ingest.control_flags(ingest.admitted(good))
    return ingest.route(df, "noise").unionByName(ingest.route(df, "imaging")).select("l_orderkey", "l_linenumber", "lane", "first_in_encode_step_1", "last_in_encode_step_1", "first_in_slice")


@query("ingest_arrival_violations", "WITH f AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1), m AS (SELECT *, max(user_id) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f) SELECT user_id, before FROM m WHERE user_id < before")
def _(spark, sf):
    """Users whose first event comes after one of a user with a larger number. Times are told apart by microseconds."""
    t = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return ingest.arrival_violations(t, "user_id", "ts").select("user_id", "before")


@query("ingest_line_elements", "SELECT l_orderkey, c::INT AS i0, l_linenumber - 1 AS i1, s::INT AS i2, min(l_quantity + c * 100 + s) AS re, 0.0 AS im FROM lineitem, range(2) a(c), range(3) b(s) GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    """Lines of two channels with three samples each, channel by channel, as k-space."""
    t = table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("ky")).agg(F.min("l_quantity").alias("q"))
    samples = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda p: F.struct((F.col("q") + F.floor(p / 3) * 100 + p % 3).alias("re"), F.lit(0.0).alias("im")))
    return ingest.line_elements(t.select("l_orderkey", "ky", samples.alias("samples")), ("l_orderkey",), 2, 7, 3).df


@query("inspect_resolve", "SELECT l_orderkey, l_linenumber, (l_linenumber = 3)::INT + (l_suppkey = 7)::INT AS score FROM lineitem ORDER BY score DESC, l_orderkey * 100 + l_linenumber LIMIT 1")
def _(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("ordinal", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return ingest.resolve(t, {"l_linenumber": 3, "l_suppkey": 7}, "ordinal").select("l_orderkey", "l_linenumber", "score")


# ---------------------------------------------------------------- files
@query("files_mat_round_trips", "SELECT kind, n_nationkey::INT AS place, (n_nationkey * 1.5 - n_regionkey)::DOUBLE AS v FROM nation, (VALUES ('vector'), ('matrix'), ('cube'), ('array4d')) k(kind) WHERE n_nationkey < 24")
def _(spark, sf):
    """24 numbers as arrays of each rank, written and read again. The file is the driver's own."""
    import os
    import tempfile

    from tessera.grid import from_numpy, to_numpy

    rows = table(spark, sf, "nation").where("n_nationkey < 24").orderBy("n_nationkey").select((F.col("n_nationkey") * 1.5 - F.col("n_regionkey")).alias("v")).collect()
    data, out = np.array([r.v for r in rows]), []
    with tempfile.TemporaryDirectory() as folder:
        for kind, shape in {"vector": (24,), "matrix": (4, 6), "cube": (2, 3, 4), "array4d": (2, 3, 2, 2)}.items():
            path = os.path.join(folder, f"{kind}.mat")
            catalog.FILES[f"write_{kind}"](path, "x", from_numpy(spark, data.reshape(shape)), compressed=kind == "cube")
            back = to_numpy(catalog.FILES[f"read_{kind}"](spark, path, "x"))
            out += [(kind, i, float(v)) for i, v in enumerate(back.ravel())]
    return spark.createDataFrame(out, "kind string, place int, v double")


@query("files_sparse_and_cfl", "SELECT n_nationkey::INT AS place, n_regionkey::DOUBLE AS sparse, n_nationkey::DOUBLE AS re, n_regionkey::DOUBLE AS im, (n_nationkey * 9)::INT AS grey FROM nation WHERE n_regionkey > 0")
def _(spark, sf):
    """Regions of nations as a sparse matrix, as single-precision complex numbers, and their keys as a grey map."""
    import os
    import tempfile

    from tessera.sources import formats

    t = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").cast("double").alias("r"))
    data = {r.k: r.r for r in t.collect()}
    z = np.array([k + 1j * data[k] for k in sorted(data)]).reshape(5, 5)
    with tempfile.TemporaryDirectory() as folder:
        path = lambda n: os.path.join(folder, n)
        formats.write_sparse(path("s.mat"), "a", t.where("r > 0").select(F.floor(F.col("k") / 5).cast("int").alias("row"), (F.col("k") % 5).alias("col"), F.col("r").alias("v")), (5, 5))
        sparse_rows = {r.row * 5 + r.col: r.v for r in formats.read_sparse(spark, path("s.mat"), "a").collect()}
        formats.write_cfl(path("c"), z)
        back = formats.read_cfl(path("c")).ravel()
        catalog.IMAGE["write_image"](path("g.pgm"), z.real * 9)
        grey = formats.read_pgm(path("g.pgm")).ravel()
    return spark.createDataFrame([(k, v, float(back[k].real), float(back[k].imag), int(grey[k])) for k, v in sorted(sparse_rows.items())], "place int, sparse double, re double, im double, grey int")


# ---------------------------------------------------------------- thresholds and denoising by enumeration
_LEVELS = f"""WITH {PX}, top AS (SELECT vec_id, max(v) AS top FROM px GROUP BY 1),
lv AS (SELECT vec_id, CASE WHEN top > 0 THEN least(floor(greatest(least(v * (255.0 / top), 255.0), 0.0) + 0.5), 255)::INT ELSE 0 END AS level FROM px JOIN top USING (vec_id)),
cum AS (SELECT vec_id, t::INT AS t, count(*) FILTER (level BETWEEN 1 AND t) / 64.0 AS p, coalesce(sum(level) FILTER (level BETWEEN 1 AND t), 0) / 64.0 AS s FROM lv, range(256) r(t) GROUP BY 1, 2)"""


def _class(lo: str, hi: str, lo_t: str, hi_t: str) -> str:
    """The score of the levels over lo_t up to hi_t: 0 for one level alone."""
    p, s = (f"({hi}.{c} - {lo}.{c})" if lo else f"{hi}.{c}" for c in "ps")
    return f"(CASE WHEN {hi_t} - {lo_t} > 1 AND {p} > 1e-15 THEN {s} * {s} / {p} ELSE 0 END)"


@query("image_multi_otsu_two_classes", f"""{_LEVELS}, e AS (SELECT vec_id, p, s FROM cum WHERE t = 255), c AS (SELECT a.vec_id, a.t, {_class('', 'a', '0', 'a.t')} + {_class('a', 'e', 'a.t', '255')} AS score FROM cum a JOIN e USING (vec_id) WHERE a.t BETWEEN 1 AND 254),
best AS (SELECT vec_id, arg_min(t, (-score, t)) AS t, max(score) AS score FROM c GROUP BY 1) SELECT vec_id, k::INT AS i0, CASE WHEN k = 1 AND score > 0 THEN t::DOUBLE ELSE 0.0 END AS v FROM best, range(2) r(k)""")
def _(spark, sf):
    return shown(image.multi_otsu_thresholds_scaled(images(spark, sf), 2))


@query("image_multi_otsu_three_classes", f"""{_LEVELS}, e AS (SELECT vec_id, p, s FROM cum WHERE t = 255), c AS (SELECT a.vec_id, a.t AS t1, b.t AS t2, {_class('', 'a', '0', 'a.t')} + ({_class('a', 'b', 'a.t', 'b.t')} + {_class('b', 'e', 'b.t', '255')}) AS score
FROM cum a JOIN cum b ON a.vec_id = b.vec_id AND a.t < b.t JOIN e ON e.vec_id = a.vec_id WHERE a.t BETWEEN 1 AND 253 AND b.t <= 254),
best AS (SELECT vec_id, arg_min([t1, t2], (-score, t1, t2)) AS t, max(score) AS score FROM c GROUP BY 1) SELECT vec_id, k::INT AS i0, CASE WHEN k > 0 AND score > 0 THEN t[k]::DOUBLE ELSE 0.0 END AS v FROM best, range(3) r(k)""")
def _(spark, sf):
    return shown(catalog.IMAGE["multi_otsu_thresholds_scaled_inplace"](images(spark, sf), 3))


_AT = "embedding[least(greatest({r}, 0), 7) * 8 + least(greatest({c}, 0), 7) + 1]::DOUBLE"
_FAR, _HERE = _AT.format(r="i0 + a + u", c="i1 + b + t"), _AT.format(r="i0 + u", c="i1 + t")


@query("image_denoise_magnitude", f"""WITH o AS (SELECT a, b FROM range(-3, 4) x(a), range(-3, 4) y(b)), d AS (SELECT vec_id, i0, i1, a, b, any_value({_AT.format(r='i0 + a', c='i1 + b')}) AS v, avg(({_FAR} - {_HERE}) * ({_FAR} - {_HERE})) AS d FROM embeddings, range(8) p(i0), range(8) q(i1), o, range(-1, 2) m(u), range(-1, 2) n(t) GROUP BY 1, 2, 3, 4, 5)
SELECT vec_id, i0::INT AS i0, i1::INT AS i1, {R('sum(exp(-d / 0.01) * v) / sum(exp(-d / 0.01))')} AS v FROM d GROUP BY 1, 2, 3""")
def _(spark, sf):
    return shown(image.denoise_magnitude(images(spark, sf)))


# ---------------------------------------------------------------- routes, runs and display
@query("recon_radial_route", f"{_gridded(2)}, f AS (SELECT vec_id, i0, i1, c, sum(zr * cos(t) - zi * sin(t)) AS re, sum(zr * sin(t) + zi * cos(t)) AS im FROM e GROUP BY 1, 2, 3, 4) SELECT vec_id, i0, i1, {R('sqrt(sum(re * re + im * im))')} AS v FROM f GROUP BY 1, 2, 3")
def _(spark, sf):
    """Samples along a trajectory through the document of the radial route."""
    route = pipeline.parse(pipeline.noncartesian_rss(4, 8, radial=True))
    return shown(pipeline.run(route, {"kspace": complex_images(spark, sf, (2, 16)), "trajectory": spiral(spark, 16)})["image"])


@query("recon_noncartesian_route", f"""WITH {C2}, {_RAD}, m AS (SELECT vec_id, s AS n, kr, kc, 0.6 * ar + 0.8 * bi AS re, 0.6 * ai - 0.8 * br AS im FROM k2 JOIN r ON s = n),
f AS (SELECT vec_id, i0::INT AS i0, i1::INT AS i1, sum(re * cos(kr * (i0 - 1.5) + kc * (i1 - 3.5)) - im * sin(kr * (i0 - 1.5) + kc * (i1 - 3.5))) AS re, sum(re * sin(kr * (i0 - 1.5) + kc * (i1 - 3.5)) + im * cos(kr * (i0 - 1.5) + kc * (i1 - 3.5))) AS im FROM m, range(4) a(i0), range(8) b(i1) GROUP BY 1, 2, 3)
SELECT vec_id, i0, i1, {R('sqrt(re * re + im * im)')} AS v FROM f""")
def _(spark, sf):
    """Samples compressed to one channel, then through the document of the route with the direct adjoint."""
    one = recon.noncartesian_coil_compress(complex_images(spark, sf, (2, 16)), constant_matrix(spark, (0.6, -0.8j)))
    route = pipeline.parse(pipeline.noncartesian_rss(4, 8))
    return shown(pipeline.run(route, {"kspace": one, "trajectory": spiral(spark, 16)})["image"])


@query("runs_lifecycle", "WITH e AS (SELECT l_orderkey, count(*) AS n, max((l_returnflag = 'R')::INT) AS stops FROM lineitem GROUP BY 1) SELECT l_orderkey AS scan_id, CASE WHEN stops = 1 AND n < 5 THEN 'rejected' ELSE ['describing', 'planning', 'verifying', 'admitting', 'starting', 'running', 'ingress_closed'][least(n, 7)] END AS state, 'none' AS cause, n >= 5 AS admitted, ((stops = 1 AND n >= 5)::INT + greatest(n - 7, 0))::INT AS refused, (n + stops)::INT AS n_events FROM e")
def _(spark, sf):
    """As many steps of its course as an order has lines; one with a returned item is rejected at last, if it still can be."""
    t = table(spark, sf, "lineitem")
    steps = F.array(*[F.lit(e) for _, e in runs.COURSE[:7]], *[F.lit("complete")] * 20)
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    events = t.select(F.col("l_orderkey").alias("scan_id"), seq.alias("seq"), F.element_at(steps, seq).alias("event"))
    stops = t.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scan_id"), F.lit(1000).alias("seq"), F.lit("reject").alias("event")).distinct()
    return runs.run_records(events.unionByName(stops))


@query("inspect_data_ranges", "WITH r AS (SELECT l_returnflag AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), p AS (SELECT *, greatest(least(0.95 * n - 0.5, n - 1), 0) AS hi, greatest(least(0.05 * n - 0.5, n - 1), 0) AS lo FROM r), q AS (SELECT k, min(v) AS least, max(v) AS most, max(v) FILTER (r = floor(lo)) + (max(v) FILTER (r = least(floor(lo) + 1, n - 1)) - max(v) FILTER (r = floor(lo))) * max(lo - floor(lo)) AS low, max(v) FILTER (r = floor(hi)) + (max(v) FILTER (r = least(floor(hi) + 1, n - 1)) - max(v) FILTER (r = floor(hi))) * max(hi - floor(hi)) AS high FROM p GROUP BY 1) SELECT k, least AS minimum, most AS maximum, round(low, 3) + 0.0 AS low, round(high, 3) + 0.0 AS high, round(low + 0.25 * (high - low), 3) + 0.0 AS center, round(0.5 * (high - low), 3) + 0.0 AS width FROM q")
def _(spark, sf):
    """Extremes, percentiles of values and of negated values, and a window of half the latter's range around its first quarter."""
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v"))
    ranges = ingest.resolved_window(ingest.data_range(t, ["k"], "v", "percentile", 95.0), "relative", 0.25, 0.5)
    shares = ranges.select("k", *[rnd(c, 3).alias(n) for c, n in (("minimum", "low"), ("maximum", "high"), ("center", "center"), ("width", "width"))])
    return ingest.data_range(t, ["k"], "v", "minimum_maximum").join(shares, "k")


@query("inspect_windowed", f"WITH {PX}, e AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) SELECT vec_id, i0, i1, {R('greatest(least((v + 0.1) / 0.2, 1), 0)')} AS absolute, {R('(v - lo) / (hi - lo)')} AS reset FROM px JOIN e USING (vec_id)")
def _(spark, sf):
    df = images(spark, sf).df
    ranges = ingest.data_range(df, ["vec_id"], "v", "minimum_maximum")
    out = df
    for name, w in (("absolute", ingest.resolved_window(ranges, "absolute", 0.0, 0.2)), ("reset", ingest.resolved_window(ranges))):
        out = out.join(w.select("vec_id", F.col("center").alias(f"{name}_center"), F.col("width").alias(f"{name}_width")), "vec_id")
    return out.select("vec_id", "i0", "i1", *[rnd(ingest.windowed(F.col("v"), F.col(f"{n}_center"), F.col(f"{n}_width"))).alias(n) for n in ("absolute", "reset")])


@query("sparse_triangular_solutions", f"WITH {SPD} SELECT vec_id, b, 0 AS j, 0 AS \"row\", {R('1 / p')} AS lower, {R('1 / p')} AS again FROM w UNION ALL SELECT vec_id, b, 0, 1, {R('(2 - r / p) / s')}, {R('(2 - r / p) / s')} FROM w")
def _(spark, sf):
    """Lower systems ((p, 0), (r, s)) x = (1, 2), entry by entry; the upper triangle is left out."""
    a = blocks(spark, sf, (2, 2), 2.0).df.select("vec_id", "b", F.col("i0").alias("row"), F.col("i1").alias("col"), "v")
    rhs = a.where("col = 0").select("vec_id", "b", F.lit(0).alias("j"), "row", (F.col("row") + 1.0).alias("v"))
    one, two = (f(a, rhs, ["vec_id", "b"]).select("vec_id", "b", "j", "row", rnd("x").alias(n)) for n, f in (("lower", sparse.spsv), ("again", sparse.spsm)))
    return one.join(two, ["vec_id", "b", "j", "row"])
