"""Summaries and comparisons of arrays."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.elementwise import isfinite
from tessera.grid import Grid

INF = float("inf")


def summarize_array(g: Grid) -> DataFrame:
    """Counts of finite, not-a-number, infinite and zero values, extremes, mean and deviation, and a fingerprint that doesn't
    depend on the order of rows."""
    v = F.hypot("re", "im") if g.is_complex else F.col("v")
    ok = isfinite(v)
    real = F.when(ok, v)
    print_ = F.xxhash64(g.linear().cast("long"), *g.values)
    return g.df.groupBy(*g.keys).agg(
        F.count("*").alias("elements"), F.count_if(ok).alias("finite"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(F.abs(v) == F.lit(INF)).alias("inf"),
        F.count_if(v == 0).alias("zero"), F.min(real).alias("least"), F.max(real).alias("most"), F.avg(real).alias("mean"), F.stddev_pop(real).alias("stddev"), F.bit_xor(print_).alias("fingerprint"),
    )


def compare_arrays(a: Grid, b: Grid, tolerance: float = 0.0) -> DataFrame:
    """Elements that differ at all and beyond the tolerance, the largest and mean difference, and its root mean square. An
    element that only one array has counts as missing."""
    both = a.df.select(*a.keys, *a.index, F.col("v").alias("x")).join(b.df.select(*b.keys, *b.index, F.col("v").alias("y")), [*a.keys, *a.index], "full_outer")
    d = F.abs(F.col("x") - F.col("y"))
    return both.groupBy(*a.keys).agg(
        F.count("*").alias("elements"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing"), F.count_if(F.col("x") != F.col("y")).alias("different"), F.count_if(d > tolerance).alias("beyond"),
        F.max(d).alias("largest"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rmse"),
    )


def delta_histogram(a: Grid, b: Grid) -> DataFrame:
    """How often each difference, rounded to a whole number, occurs."""
    d = a.zip(b, lambda x, y: F.round(x - y))
    return d.df.groupBy(*d.keys, F.col("v").cast("long").alias("delta")).agg(F.count("*").alias("n"))


def describe_layout(g: Grid) -> dict:
    strides, step = [], 1
    for n in reversed(g.shape):
        strides.insert(0, step)
        step *= n
    return {"rank": g.rank, "shape": list(g.shape), "strides": strides, "elements": g.size, "complex": g.is_complex, "keys": list(g.keys)}


def format_shape(shape: tuple[int, ...]) -> str:
    return " x ".join(map(str, shape))


def format_row(row) -> str:
    """One row of a summary or comparison as JSON."""
    return json.dumps(row.asDict(), sort_keys=True)
