"""Known results of reconstruction routes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.grid import Grid, ShapeError, from_numpy, to_numpy
from tessera.operators import arrays, ingest, nufft, recon
from tessera.plans import pipeline
from tessera.registry import OPERATORS, ConfigError


def test_all_operators_are_registered():
    assert len(OPERATORS) == 33


def test_cartesian_dc_is_flat(spark):
    k = np.zeros((2, 2, 2), complex)
    k[0, 0, 0], k[1, 0, 0] = 4, 8
    out = pipeline.run(pipeline.parse(pipeline.cartesian_rss()), {"kspace": from_numpy(spark, k)})["image"]
    assert np.allclose(to_numpy(out), math.sqrt(5), atol=1e-5)


def test_cartesian_with_all_conditioning(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(2, 64)) + 1j * rng.normal(size=(2, 64))
    k = rng.normal(size=(2, 4, 6)) + 1j * rng.normal(size=(2, 4, 6))
    ref = rng.normal(size=(2, 3, 6)) + 1j * rng.normal(size=(2, 3, 6))
    doc = pipeline.cartesian_rss(noise=True, phase=True, virtual_channels=2, crop=(1, 4))
    out = pipeline.run(pipeline.parse(doc), {"kspace": from_numpy(spark, k), "noise_samples": from_numpy(spark, noise), "phase_reference": from_numpy(spark, ref), "calibration": from_numpy(spark, k)})["image"]
    x = noise - noise.mean(1, keepdims=True)
    w, v = np.linalg.eigh(x.conj() @ x.T / 64)
    y = np.einsum("ab,bij->aij", (v / np.sqrt(np.maximum(w, 1e-6))) @ v.conj().T, k)
    s = ref.sum(1)
    y = y * (s.conj() / np.abs(s))[:, None, :]
    flat = k.reshape(2, -1)
    _, b = np.linalg.eigh(flat @ flat.conj().T / 24)
    y = np.einsum("ab,bij->aij", b[:, ::-1].conj().T, y)[:, :, 1:5]
    want = np.sqrt((np.abs(np.fft.ifft2(y)) ** 2).sum(0))
    assert np.allclose(to_numpy(out), want, atol=1e-9)


def test_noise_model(spark):
    noise = np.array([[-1, 1, -1, 1], [-2, -2, 2, 2]], complex)
    assert np.allclose(to_numpy(recon.noise_model_estimate(from_numpy(spark, noise))), np.diag([1, 0.5]), atol=2e-4)
    with pytest.raises(ShapeError):
        recon.noise_model_estimate(from_numpy(spark, noise[:, :1]))


def test_phase_and_basis(spark):
    ref = np.array([[[1j, -1], [1j, -1]], [[1, 0], [1, 0]]], complex)
    assert np.allclose(to_numpy(recon.phase_correction_estimate(from_numpy(spark, ref))), [[-1j, -1], [1, 1]], atol=1e-5)
    k = np.array([[[2, -2], [2, -2]], [[1, 1], [-1, -1]]], complex)
    b = to_numpy(recon.coil_compression_basis_estimate(from_numpy(spark, k), 1))
    assert abs(np.linalg.norm(b) - 1) < 1e-9 and abs(b[0, 0]) > 0.999 and abs(b[0, 1]) < 1e-3


def test_noncartesian_two_samples(spark):
    k = from_numpy(spark, np.array([[1, 2], [3, 4]], complex))
    t = spark.createDataFrame([(0, 0.0, 0.0), (1, math.pi, 0.0)], "sample int, k_row double, k_col double")
    image = to_numpy(recon.coil_combine_rss(recon.noncartesian_adjoint_reconstruct(k, t, 2, 2)))
    x = np.array([[1, 2], [3, 4]])
    r = np.arange(2)[:, None] - 0.5
    want = np.sqrt(sum(np.abs(a + b * np.exp(1j * math.pi * r)) ** 2 for a, b in x)) * np.ones((1, 2))
    assert np.allclose(image, want) and np.allclose(image, math.sqrt(30), atol=1e-5)
    with pytest.raises(Exception, match="no place"):
        recon.noncartesian_adjoint_reconstruct(k, t.where("sample = 0"), 2, 2).df.collect()


def test_radial_units_agree(spark):
    rng = np.random.default_rng(5)
    k = from_numpy(spark, rng.normal(size=(2, 5)) + 1j * rng.normal(size=(2, 5)))
    raw = rng.uniform(-0.4, 0.4, (5, 2))
    found = []
    for unit, scale in (("cycles_per_fov", (1, 1)), ("radians_per_pixel", (2 * math.pi, 2 * math.pi)), ("matrix_index", (4, 2))):
        rows = [(i, float(raw[i, 0] * scale[0]), float(raw[i, 1] * scale[1])) for i in range(5)]
        t = nufft.normalized_trajectory(spark.createDataFrame(rows, "sample int, kx double, ky double"), unit, 2, 4)
        found.append(to_numpy(recon.coil_combine_rss(recon.radial_gridding_reconstruct(k, t, 2, 4))))
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])
    with pytest.raises(Exception, match="outside"):
        nufft.normalized_trajectory(spark.createDataFrame([(0, 0.6, 0.0)], "sample int, kx double, ky double"), "cycles_per_fov", 2, 4).collect()


def test_gridding_on_bins_is_the_direct_transform(spark):
    rows, cols = 4, 8
    spots = [(0, 0, 1 + 2j), (1, 3, -1j), (2, 5, 0.5 + 0j)]
    df = spark.createDataFrame([(a * 2 * math.pi / rows, b * 2 * math.pi / cols, float(z.real), float(z.imag)) for a, b, z in spots], "k_row double, k_col double, re double, im double")
    direct = to_numpy(nufft.adjoint(df.withColumn("re", F.col("re") * F.hypot("k_row", "k_col")).withColumn("im", F.col("im") * F.hypot("k_row", "k_col")), (), rows, cols))
    assert np.allclose(to_numpy(nufft.radial_linear_gridding2_adjoint(df, (), rows, cols)), direct)


def test_clamp_keeps_nan(spark):
    g = from_numpy(spark, np.array([[1.0, math.nan], [math.inf, -math.inf]]))
    out = to_numpy(recon.image_clamp_float32(g, -2.0, 3.0))
    assert out[0, 0] == 1 and math.isnan(out[0, 1]) and out[1, 0] == 3 and out[1, 1] == -2


def test_grappa_fills_missing_lines(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:32, 0:32]
    obj = np.exp(-(((y - 15) / 6) ** 2 + ((x - 15) / 6) ** 2))
    maps = np.stack([np.exp(-(((y - a) / 20) ** 2 + ((x - b) / 20) ** 2)) for a, b in ((5, 5), (26, 5), (5, 26), (26, 26))])
    k = np.fft.fftshift(np.fft.fft2(obj * maps), axes=(1, 2)) + 1e-6 * rng.normal(size=(4, 32, 32))
    full = from_numpy(spark, k)
    kernel = recon.cartesian_grappa_kernel_calibrate(full, lines=4, columns=5)
    part = Grid(full.df.where("i1 % 2 = 0"), full.shape, (), True)
    got = to_numpy(recon.cartesian_grappa_reconstruct(part, kernel, lines=4, columns=5))
    zero = k.copy()
    zero[:, 1::2] = 0
    assert np.linalg.norm(got - k) < 0.1 * np.linalg.norm(zero - k)


def test_sense_unfolds(spark):
    rng = np.random.default_rng(2)
    img = rng.normal(size=(4, 3)) + 1j * rng.normal(size=(4, 3))
    maps = rng.normal(size=(4, 3, 4)) + 1j * rng.normal(size=(4, 3, 4))
    folded = (img[:2, :, None] * maps[:2]) + (img[2:, :, None] * maps[2:])
    out = recon.cartesian_sense_reconstruct(from_numpy(spark, folded), from_numpy(spark, maps), 2)
    assert np.allclose(to_numpy(out), img)
    n = 40
    t = rng.uniform(-3, 3, (n, 2))
    r, c = np.mgrid[0:4, 0:3]
    e = np.exp(-1j * (np.outer(t[:, 0], r.ravel() - 1.5) + np.outer(t[:, 1], c.ravel() - 1.0)))
    k = np.stack([e @ (img * maps[:, :, i]).ravel() for i in range(4)])
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(t)], "sample int, k_row double, k_col double")
    out = recon.noncartesian_sense_reconstruct(from_numpy(spark, k), places, from_numpy(spark, maps), 40)
    assert np.allclose(to_numpy(out), img, atol=1e-5)


def _document(**change):
    return pipeline.cartesian_rss() | change


@pytest.mark.parametrize(
    "change",
    [
        {"runtime": {}}, {"kind": "Other"}, {"nodes": []}, {"edges": []}, {"provider_requirements": []},
        {"nodes": [{"id": "combine", "operator": {"provider": "coils", "id": "nothing"}, "config": {}}]},
        {"input_profile": {"kind": "acquisitions", "container": {"mode": "auto", "path": "/x"}}},
    ],
)
def test_invalid_documents(change):
    with pytest.raises(ConfigError):
        pipeline.parse(_document(**change))


def test_more_invalid_documents():
    d = _document()
    d["edges"] = [d["edges"][0] | {"to": {"node": "transform", "port": "kspace"}}]
    with pytest.raises(ConfigError):
        pipeline.parse(d)
    d = pipeline.cartesian_rss(crop=(0, 2))
    d["nodes"][0]["config"] = {"offset": -1, "output_columns": 2}
    with pytest.raises(ConfigError):
        pipeline.parse(d)
    d["nodes"][0]["config"] = {"offset": 0, "output_columns": 2, "threads": 4}
    with pytest.raises(ConfigError):
        pipeline.parse(d)
    assert pipeline.byte_size("32G") == 32 << 30 and pipeline.byte_size("512") == 512
    with pytest.raises(ConfigError):
        pipeline.byte_size("many")


def test_graph_table(spark):
    p = pipeline.parse(pipeline.cartesian_rss(crop=(0, 2)))
    assert pipeline.graph(spark, p).count() == 4 and p.order == ["crop", "transform", "combine"]


def test_shapes_are_asserted(spark):
    a, b = from_numpy(spark, np.ones((2, 3))), from_numpy(spark, np.ones((3, 2)))
    with pytest.raises(ShapeError):
        a.zip(b, lambda x, y: x + y)
    short = Grid(a.df.where("i0 = 0"), a.shape)
    with pytest.raises(Exception, match="missing"):
        a.zip(short, lambda x, y: x + y).df.collect()
    with pytest.raises(Exception, match="does not have"):
        short.pack().collect()
    with pytest.raises(ShapeError):
        arrays.crop(a, (0, 2), (2, 2))


def test_frames_from_lines(spark):
    line = lambda ky, z: ("s", ky, [(float(x.real), float(x.imag)) for x in z])
    rows = [line(1, [0, 0, 0, 0]), line(0, [4, 0, 8, 0])]
    df = spark.createDataFrame(rows, "scan string, ky int, samples array<struct<re:float,im:float>>")
    k = ingest.line_elements(df, ("scan",), 2, 2, 2)
    out = pipeline.run(pipeline.parse(pipeline.cartesian_rss()), {"kspace": k})["image"]
    assert all(abs(r.v - math.sqrt(5)) < 1e-5 for r in out.df.collect())
