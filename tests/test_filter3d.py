"""The filter over three axes: its two forms against NumPy, nulls, missing elements, and no table sent to the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.catalog import IMAGE
from tessera.grid import ShapeError, from_arrays, from_numpy
from tessera.operators.image import filter3d_replicate

SHAPE = (3, 2, 4)


def brute(x, k):
    """x with None for null: a list of the sums over what is there, None where nothing is."""
    out = []
    for at in np.ndindex(x.shape):
        read = [(k[t], x[tuple(min(max(i + j - m // 2, 0), n - 1) for i, j, m, n in zip(at, t, k.shape, x.shape))]) for t in np.ndindex(k.shape)]
        there = [w * v for w, v in read if v is not None]
        out.append(sum(there) if there else None)
    return out


def volumes(spark, arrays):
    return from_arrays(spark.createDataFrame(list(enumerate(arrays)), "k long, x array<double>"), "x", SHAPE, ("k",))


def moved(g):
    """The same grid, without its packed form."""
    return g.map(lambda v: v + 0.0)


def listed(g):
    return [r.v for r in g.df.orderBy(*g.keys, *g.index).collect()]


@pytest.mark.parametrize("form", [lambda g: g, moved], ids=["packed", "long"])
@pytest.mark.parametrize("size", [(3, 3, 3), (2, 4, 1), (1, 1, 1), (7, 5, 9)])
def test_equals_brute_force(spark, form, size):
    rng = np.random.default_rng(3)
    k = rng.integers(-4, 5, size).astype(float)
    data = [rng.integers(-9, 10, SHAPE).astype(float) for _ in range(3)]
    assert listed(IMAGE["filter3d_replicate_in_place"](form(volumes(spark, [x.ravel().tolist() for x in data])), k)) == [v for x in data for v in brute(x, k)]


@pytest.mark.parametrize("form", [lambda g: g, moved], ids=["packed", "long"])
def test_nulls_count_for_nothing(spark, form):
    x = np.arange(24.0).reshape(SHAPE).astype(object)
    x[0, :, 1:] = x[2, 1, 3] = None
    none = np.full(SHAPE, None)
    k = np.arange(1.0, 4.0).reshape(1, 1, 3)
    want = brute(x, k) + brute(none, k)
    assert None in want[:24]
    assert listed(filter3d_replicate(form(volumes(spark, [x.ravel().tolist(), none.ravel().tolist()])), k)) == want


def test_complex_and_keyless(spark):
    rng = np.random.default_rng(5)
    z, k = rng.normal(size=SHAPE) + 1j * rng.normal(size=SHAPE), rng.normal(size=(3, 3, 3))
    g = from_numpy(spark, z)
    for form in (g, g.map(lambda re, im: (re + 0.0, im + 0.0))):
        got = filter3d_replicate(form, k).df.orderBy("i0", "i1", "i2").collect()
        assert np.allclose([complex(r.re, r.im) for r in got], brute(z, k))


def test_a_missing_element_is_an_error(spark):
    whole = np.arange(24.0).tolist()
    k = np.ones((3, 3, 3))
    for g in (volumes(spark, [whole, whole[:23]]), moved(volumes(spark, [whole, whole[:23]])), moved(volumes(spark, [whole, [*whole, 1.0]]))):
        with pytest.raises(Exception, match="does not have"):
            filter3d_replicate(g, k).df.collect()
    for bad in (np.ones((3, 3)), np.ones((0, 3, 3))):
        with pytest.raises(ShapeError):
            filter3d_replicate(volumes(spark, [whole]), bad)


def test_no_side_is_broadcast(spark, sf_dir):
    """With any table's size under the limit, as Spark guesses it: the long form of a small file isn't small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (entry.queries()["image_filter3d"](spark, sf_dir), filter3d_replicate(moved(volumes(spark, [np.arange(24.0).tolist()])), np.ones((3, 3, 3))).df)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("Broadcast" in p or "Join" in p for p in plans)
    assert "Exchange" not in plans[0] and plans[1].count("Exchange hashpartitioning") == 1
