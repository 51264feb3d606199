import numpy as np

from tessera.catalog import CATALOG, find
from tessera.grid import from_numpy, to_numpy
from tessera.operators import raster


def test_catalog_is_callable():
    assert sum(map(len, CATALOG.values())) > 450
    assert all(callable(f) for ops in CATALOG.values() for f in ops.values())
    assert len(find("transpose")) == 2 and not find("nothing")


def test_constructors_and_folds(spark):
    c = CATALOG["array"]
    assert to_numpy(c["full_cube"](spark, 2, 1, 3, 4.5)).tolist() == [[[4.5] * 3], [[4.5] * 3]]
    assert np.allclose(to_numpy(c["linspace_vector"](spark, 5, 0.0, 2.0)), np.linspace(0, 2, 5))
    r = to_numpy(c["uniform_random_matrix"](spark, 20, 20, -1.0, 1.0, seed=3))
    assert r.min() >= -1 and r.max() < 1 and abs(r.mean()) < 0.1 and np.array_equal(r, to_numpy(c["uniform_random_matrix"](spark, 20, 20, -1.0, 1.0, seed=3)))
    g = from_numpy(spark, np.array([[1.0, 2.0], [3.0, 4.0]]))
    from pyspark.sql import functions as F

    assert c["accumulate"](g, F.lit(0.0), lambda a, x: a * 2 + x).first().v == 26.0
    assert to_numpy(c["transform_linear_indexed"](g, lambda i, v: i + v)).tolist() == [[1, 3], [5, 7]]
    assert to_numpy(c["transform_indexed"](g, lambda i, j, v: v * j)).tolist() == [[0, 2], [0, 4]]
    assert to_numpy(CATALOG["image"]["cwise_divide"](g, g)).tolist() == [[1, 1], [1, 1]]
    assert to_numpy(CATALOG["image"]["resize_nearest"](g, 3, 2)).tolist() == [[1, 2], [3, 4], [3, 4]]
    assert to_numpy(CATALOG["fourier"]["convolve2d_valid_fft"](g, np.ones((2, 2)))).round(9).tolist() == [[10]]


def test_block_matching_and_rotation(spark):
    rng = np.random.default_rng(4)
    clean = np.where((np.arange(20)[:, None] // 5 + np.arange(20) // 5) % 2 == 0, 10.0, 0.0)
    noisy = clean + rng.normal(size=clean.shape)
    for f in (lambda g: CATALOG["image"]["bm3d_denoise_magnitude"](g, 1.0), lambda g: CATALOG["image"]["denoise_magnitude"](g, 2.0)):
        out = to_numpy(f(from_numpy(spark, noisy)))
        assert ((out - clean) ** 2).mean() < 0.85 * ((noisy - clean) ** 2).mean()
    smooth = to_numpy(CATALOG["image"]["rotate_cubic_bspline_smooth"](from_numpy(spark, np.ones((6, 6))), 0.0))
    assert np.allclose(smooth[2:4, 2:4], 1)


def test_raster(tmp_path):
    im = raster.make_bgr_image(5, 7, (1, 2, 3))
    raster.draw_line(im, (0, 0), (4, 4), (9, 9, 9))
    raster.draw_polyline(im, [(0, 6), (2, 6), (9, 6)], (8, 8, 8))
    raster.draw_circle(im, (2, 2), 1, (7, 7, 7), True)
    assert im[4, 4].tolist() == [9, 9, 9] and im[4, 6].tolist() == [8, 8, 8] and im[2, 2].tolist() == [7, 7, 7] and im[0, 3].tolist() == [1, 2, 3]
    raster.write_bgr_image(str(tmp_path / "p"), im)
    assert (tmp_path / "p").read_bytes().startswith(b"P6 7 5 255\n\x09\x09\x09")
