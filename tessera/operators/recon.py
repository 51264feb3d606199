"""Reconstruction operators on frames: a frame is a grid, its keys say which one.

k-space: axes (channel, ky, kx); coil images: (ky, kx, channel); images: (ky, kx); non-Cartesian samples: rows
(keys, channel, sample, re, im) with a trajectory (keys, sample, k_row, k_col).
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cplx
from tessera.functions import elementwise as el
from tessera.grid import Grid, ShapeError
from tessera.operators import arrays, nufft
from tessera.operators.linalg import contract, whitening_from_covariance
from tessera.registry import Option, operator

EIGENVALUE_FLOOR = 1e-6
CALIBRATION, CONDITIONING, CARTESIAN = "calibration", "kspace-conditioning", "cartesian-recon"
NONCARTESIAN, COMBINE, IMAGE, NORMALIZATION, QUALITY = "noncartesian-recon", "coil-combine", "image-ops", "image-normalization", "image-quality"
KSPACE, NOISE, WHITE, REFERENCE, PHASOR, BASIS = "kspace-frame", "noise-calibration-frame", "noise-model", "phase-reference-frame", "phase-model", "coil-compression-basis"
COILS, PLANE, MAPS, SAMPLES, TRAJECTORY, PICTURE = "coil-image-frame", "complex-image-frame", "sensitivity-map", "noncartesian-kspace-frame", "trajectory-frame", "image-frame"


# ---------------------------------------------------------------- calibration
def channel_covariance(noise: Grid) -> Grid:
    """Population covariance over samples of channels less their means: mean(conj(x_r) x_c)."""
    n = noise.shape[1]
    means = noise.df.groupBy(*noise.keys, "i0").agg(F.avg("re").alias("m_re"), F.avg("im").alias("m_im"))
    df = noise.df.join(means, [*noise.keys, "i0"])
    centred = replace(noise, df=df.select(*noise.keys, "i0", "i1", (F.col("re") - F.col("m_re")).alias("re"), (F.col("im") - F.col("m_im")).alias("im")))
    return contract(centred, centred, 1, 1, conj_a=True).map(lambda re, im: (re / n, im / n))


@operator(CALIBRATION, "noise_model_estimate", {"noise": NOISE}, {"noise_model": WHITE})
def noise_model_estimate(noise: Grid) -> Grid:
    """The whitening matrix of noise (channel, sample); eigenvalues are at least 1e-6. At least two samples."""
    if noise.shape[1] < 2:
        raise ShapeError("noise_model_estimate needs two samples")
    return whitening_from_covariance(channel_covariance(noise), EIGENVALUE_FLOOR)


@operator(CALIBRATION, "phase_correction_estimate", {"reference": REFERENCE}, {"phase_model": PHASOR})
def phase_correction_estimate(reference: Grid) -> Grid:
    """conj(s) / |s| of the sum s over lines, 1 where s is 0; (channel, line, kx) gives (channel, kx)."""
    s = arrays.sum_axis(reference, 1)

    def f(re, im):
        m = F.hypot(re, im)
        safe = F.when(m == 0, 1.0).otherwise(m)
        return F.when(m == 0, 1.0).otherwise(re / safe), F.when(m == 0, 0.0).otherwise(-im / safe)

    return s.map(f)


@operator(CALIBRATION, "coil_compression_basis_estimate", {"kspace": KSPACE}, {"basis": BASIS}, virtual_channels=Option(int, 1, 64))
def coil_compression_basis_estimate(kspace: Grid, virtual_channels: int) -> Grid:
    """The strongest components of the channels' uncentred covariance mean(x_r conj(x_c)), as rows of conjugated
    eigenvectors, strongest first."""
    c, ky, kx = kspace.shape
    if virtual_channels > c:
        raise ShapeError(f"{virtual_channels} virtual channels of {c}")
    flat = arrays.reshape(kspace, c, ky * kx)
    # contract() conjugates its first operand: the covariance wanted is the conjugate of that
    cov = contract(flat, flat, 1, 1, conj_a=True).map(lambda re, im: (re / (ky * kx), -im / (ky * kx)))

    def f(m: np.ndarray) -> np.ndarray:
        _, v = np.linalg.eigh(m)
        return v[:, ::-1][:, :virtual_channels].conj().T

    return cov.kernel(f, (virtual_channels, c), True)


@operator(CALIBRATION, "noncartesian_phase_correction_estimate", {"reference": REFERENCE}, {"phase_model": PHASOR})
def noncartesian_phase_correction_estimate(reference: Grid) -> Grid:
    """As phase_correction_estimate(), over (channel, line, sample)."""
    return phase_correction_estimate(reference)


@operator(CALIBRATION, "sensitivity_map_estimate", {"coil_images": COILS}, {"maps": MAPS}, epsilon=Option(float, 0, None, False, 0.0))
def sensitivity_map_estimate(coil_images: Grid, epsilon: float = 0.0) -> Grid:
    """Each coil's image over the root of the coils' summed squares; 0 where that is not above epsilon."""
    rss = coil_combine_rss(coil_images)
    df = coil_images.df.join(rss.df.withColumnRenamed("v", "m"), [*coil_images.keys, "i0", "i1"])
    part = lambda c: F.when(F.col("m") > epsilon, F.col(c) / F.when(F.col("m") > epsilon, F.col("m"))).otherwise(0.0).alias(c)
    return replace(coil_images, df=df.select(*coil_images.keys, "i0", "i1", "i2", part("re"), part("im")))


def grappa_targets(shape: tuple[int, int], size: tuple[int, int], accel: int) -> list[tuple[int, int]]:
    """Source offsets (ky, kx) of a kernel: `size` lines `accel` apart around, and an odd number of columns."""
    lines = [accel * (j - (size[0] // 2 - 1)) for j in range(size[0])]
    return [(a, b) for a in lines for b in range(-(size[1] // 2), size[1] // 2 + 1)]


def _grappa_system(x: np.ndarray, offs: list[tuple[int, int]], shift: int) -> tuple[np.ndarray, np.ndarray]:
    c, rows, cols = x.shape
    lo, hi = min(a for a, _ in offs), max(a for a, _ in offs)
    wide = max(b for _, b in offs)
    src, dst = [], []
    for i in range(-lo, rows - max(hi, shift)):
        for j in range(wide, cols - wide):
            src.append(np.concatenate([x[:, i + a, j + b] for a, b in offs]))
            dst.append(x[:, i + shift, j])
    return np.array(src), np.array(dst)


@operator(CALIBRATION, "cartesian_grappa_kernel_calibrate", {"kspace": KSPACE}, {"kernel": "grappa-kernel"}, lines=Option(int, 2, 8, False, 2), columns=Option(int, 1, 9, False, 3), acceleration=Option(int, 2, 8, False, 2), ridge=Option(float, 0, None, False, 1e-6))
def cartesian_grappa_kernel_calibrate(kspace: Grid, lines: int = 2, columns: int = 3, acceleration: int = 2, ridge: float = 1e-6) -> Grid:
    """Least-squares weights (missing line, source, target channel) from fully sampled k-space."""
    c = kspace.shape[0]
    offs = grappa_targets(kspace.shape[1:], (lines, columns), acceleration)

    def f(x: np.ndarray) -> np.ndarray:
        out = []
        for shift in range(1, acceleration):
            s, t = _grappa_system(x, offs, shift)
            g = s.conj().T @ s
            out.append(np.linalg.solve(g + ridge * np.trace(g).real / len(g) * np.eye(len(g)), s.conj().T @ t))
        return np.array(out)

    return kspace.kernel(f, (acceleration - 1, len(offs) * c, c), True)


# ---------------------------------------------------------------- conditioning
def _channels(model: Grid, kspace: Grid) -> Grid:
    return contract(model, kspace, 1, 0)


@operator(CONDITIONING, "noise_prewhiten", {"kspace": KSPACE, "noise_model": WHITE}, {"prewhitened_kspace": KSPACE})
def noise_prewhiten(kspace: Grid, noise_model: Grid) -> Grid:
    """y = W x over channels."""
    return _channels(noise_model, kspace)


@operator(CONDITIONING, "coil_compress", {"kspace": KSPACE, "basis": BASIS}, {"compressed_kspace": KSPACE})
def coil_compress(kspace: Grid, basis: Grid) -> Grid:
    """y = B x over channels."""
    return _channels(basis, kspace)


def _by_phasor(data: Grid, model: Grid, axis: str) -> Grid:
    keys = [k for k in data.keys if k in model.keys]
    m = model.df.select(*model.keys, "i0", F.col("i1").alias(axis), F.col("re").alias("p_re"), F.col("im").alias("p_im"))
    re, im = cplx.multiply(F.col("re"), F.col("im"), F.col("p_re"), F.col("p_im"))
    return replace(data, df=data.df.join(m, [*keys, "i0", axis]).select(*data.keys, *data.index, re.alias("re"), im.alias("im")))


@operator(CONDITIONING, "phase_correct", {"kspace": KSPACE, "phase_model": PHASOR}, {"corrected_kspace": KSPACE})
def phase_correct(kspace: Grid, phase_model: Grid) -> Grid:
    """Each line by the phasor of its channel and column."""
    return _by_phasor(kspace, phase_model, "i2")


@operator(CONDITIONING, "noncartesian_phase_correct", {"kspace": SAMPLES, "phase_model": PHASOR}, {"corrected_kspace": SAMPLES})
def noncartesian_phase_correct(kspace: Grid, phase_model: Grid) -> Grid:
    return _by_phasor(kspace, phase_model, "i1")


@operator(CONDITIONING, "readout_oversampling_remove", {"kspace": KSPACE}, {"cropped_kspace": KSPACE}, offset=Option(int, 0), output_columns=Option(int, 1))
def readout_oversampling_remove(kspace: Grid, offset: int, output_columns: int) -> Grid:
    """The columns [offset, offset + output_columns) of k-space."""
    c, ky, _ = kspace.shape
    return arrays.crop(kspace, (0, 0, offset), (c, ky, output_columns))


@operator(CONDITIONING, "noncartesian_noise_prewhiten", {"kspace": SAMPLES, "noise_model": WHITE}, {"prewhitened_kspace": SAMPLES})
def noncartesian_noise_prewhiten(kspace: Grid, noise_model: Grid) -> Grid:
    return _channels(noise_model, kspace)


@operator(CONDITIONING, "noncartesian_coil_compress", {"kspace": SAMPLES, "basis": BASIS}, {"compressed_kspace": SAMPLES})
def noncartesian_coil_compress(kspace: Grid, basis: Grid) -> Grid:
    return _channels(basis, kspace)


# ---------------------------------------------------------------- reconstruction
@operator(CARTESIAN, "cartesian_ifft2_coil_images", {"kspace": KSPACE}, {"coil_images": COILS})
def cartesian_ifft2_coil_images(kspace: Grid) -> Grid:
    """Each channel's inverse transform, divided by the number of points, without a shift; coils go last."""
    c, ky, kx = kspace.shape
    one = Grid(kspace.df.withColumnRenamed("i0", "channel").withColumnsRenamed({"i1": "i0", "i2": "i1"}), (ky, kx), (*kspace.keys, "channel"), kspace.is_complex)
    out = one.kernel(np.fft.ifft2, (ky, kx), True, batched=True)
    return Grid(out.df.select(*kspace.keys, "i0", "i1", F.col("channel").cast("int").alias("i2"), "re", "im"), (ky, kx, c), kspace.keys, True)


@operator(CARTESIAN, "cartesian_partial_fourier", {"kspace": KSPACE}, {"kspace": KSPACE}, acquired_lines=Option(int, 1))
def cartesian_partial_fourier(kspace: Grid, acquired_lines: int) -> Grid:
    """Lines from acquired_lines on are the conjugates of their mirror places."""
    c, ky, kx = kspace.shape
    mirror = kspace.df.where(F.col("i1") < acquired_lines).select(*kspace.keys, "i0", F.pmod(F.lit(ky) - F.col("i1"), F.lit(ky)).cast("int").alias("i1"), F.pmod(F.lit(kx) - F.col("i2"), F.lit(kx)).cast("int").alias("i2"), "re", (-F.col("im")).alias("im"))
    return replace(kspace, df=kspace.df.where(F.col("i1") < acquired_lines).unionByName(mirror.where(F.col("i1") >= acquired_lines))).filled((c, ky, kx))


@operator(CARTESIAN, "cartesian_grappa_reconstruct", {"kspace": KSPACE, "kernel": "grappa-kernel"}, {"kspace": KSPACE}, lines=Option(int, 2, 8, False, 2), columns=Option(int, 1, 9, False, 3), acceleration=Option(int, 2, 8, False, 2))
def cartesian_grappa_reconstruct(kspace: Grid, kernel: Grid, lines: int = 2, columns: int = 3, acceleration: int = 2) -> Grid:
    """Missing lines as weighted sums of sampled places around them: a join on the source offsets, a sum by target."""
    c, ky, kx = kspace.shape
    offs = grappa_targets((ky, kx), (lines, columns), acceleration)
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("s")) for n, (a, b) in enumerate(offs) for s in range(1, acceleration)])
    src = kspace.df.where(F.col("i1") % acceleration == 0).withColumn("o", F.explode(table))
    row, col = F.pmod(F.col("i1") - F.col("o.a") + F.col("o.s"), F.lit(ky)), F.pmod(F.col("i2") - F.col("o.b"), F.lit(kx))
    src = src.select(*kspace.keys, (F.col("o.n") * c + F.col("i0")).cast("int").alias("source"), (F.col("o.s") - 1).alias("shift"), row.cast("int").alias("row"), col.cast("int").alias("col"), "re", "im").where(F.col("row") % acceleration == F.col("shift") + 1)
    shared = [k for k in kspace.keys if k in kernel.keys]
    w = kernel.df.select(*kernel.keys, F.col("i0").alias("shift"), F.col("i1").alias("source"), F.col("i2").alias("target"), F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    re, im = cplx.multiply(F.col("re"), F.col("im"), F.col("w_re"), F.col("w_im"))
    made = src.join(w, [*shared, "shift", "source"]).groupBy(*kspace.keys, F.col("target").alias("i0"), F.col("row").alias("i1"), F.col("col").alias("i2")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return replace(kspace, df=kspace.df.where(F.col("i1") % acceleration == 0).unionByName(made))


@operator(CARTESIAN, "cartesian_sense_reconstruct", {"aliased": COILS, "maps": MAPS}, {"image": PLANE}, acceleration=Option(int, 2, 8))
def cartesian_sense_reconstruct(aliased: Grid, maps: Grid, acceleration: int) -> Grid:
    """Unfolds images aliased along rows: for each aliased pixel the least-squares solution over its coils. aliased has
    rows / acceleration rows."""
    rows, cols, coils = maps.shape
    small = rows // acceleration
    if aliased.shape != (small, cols, coils):
        raise ShapeError(f"aliased images of {aliased.shape} for maps of {maps.shape}")
    s = maps.df.withColumns({"fold": F.floor(F.col("i0") / F.lit(small)).cast("int"), "i0": (F.col("i0") % small).cast("int")})
    packed = s.groupBy(*maps.keys, "i0", "i1").agg(F.array_sort(F.collect_list(F.struct("i2", "fold", "re", "im"))).alias("s"))
    seen = aliased.df.groupBy(*aliased.keys, "i0", "i1").agg(F.array_sort(F.collect_list(F.struct("i2", "re", "im"))).alias("y"))
    both = seen.join(packed, [*[k for k in aliased.keys if k in maps.keys], "i0", "i1"])

    @F.pandas_udf("array<struct<re:double,im:double>>")
    def unfold(s_re, s_im, y_re, y_im):
        import pandas as pd

        out = []
        for a, b, c, d in zip(s_re, s_im, y_re, y_im, strict=True):
            m = (np.array(a) + 1j * np.array(b)).reshape(coils, acceleration)
            x = np.linalg.lstsq(m, np.array(c) + 1j * np.array(d), rcond=1e-6)[0]
            out.append([{"re": float(v.real), "im": float(v.imag)} for v in x])
        return pd.Series(out)

    out = both.select(*aliased.keys, "i0", "i1", F.posexplode(unfold("s.re", "s.im", "y.re", "y.im")).alias("fold", "x"))
    return Grid(out.select(*aliased.keys, (F.col("i0") + F.col("fold") * small).cast("int").alias("i0"), "i1", "x.re", "x.im"), (rows, cols), aliased.keys, True)


def _with_trajectory(kspace: Grid, trajectory: DataFrame) -> DataFrame:
    """Samples with their places; a sample without one, or the reverse, is an error."""
    shared = [k for k in kspace.keys if k in trajectory.columns]
    samples = kspace.df.select(*kspace.keys, F.col("i0").alias("channel"), F.col("i1").alias("sample"), "re", "im")
    both = samples.join(trajectory.select(*shared, "sample", "k_row", "k_col"), [*shared, "sample"], "left")
    fail = F.raise_error(F.lit("a sample has no place in the trajectory")).cast("double")
    return both.withColumns({c: F.coalesce(c, fail) for c in ("k_row", "k_col")})


def _coils_last(g: Grid, keys: tuple[str, ...], coils: int) -> Grid:
    return Grid(g.df.select(*keys, "i0", "i1", F.col("channel").cast("int").alias("i2"), "re", "im"), (*g.shape, coils), keys, True)


@operator(NONCARTESIAN, "noncartesian_adjoint_reconstruct", {"kspace": SAMPLES, "trajectory": TRAJECTORY}, {"coil_images": COILS}, rows=Option(int, 1), cols=Option(int, 1))
def noncartesian_adjoint_reconstruct(kspace: Grid, trajectory: DataFrame, rows: int, cols: int) -> Grid:
    """The unweighted adjoint transform of each channel; channels x rows x cols x samples is at most 2^28."""
    if kspace.shape[0] * rows * cols * kspace.shape[1] > 1 << 28:
        raise ShapeError("noncartesian_adjoint_reconstruct: too much work for the direct transform")
    return _coils_last(nufft.adjoint(_with_trajectory(kspace, trajectory), (*kspace.keys, "channel"), rows, cols), kspace.keys, kspace.shape[0])


@operator(NONCARTESIAN, "radial_gridding_reconstruct", {"kspace": SAMPLES, "trajectory": TRAJECTORY}, {"coil_images": COILS}, rows=Option(int, 2, 512), cols=Option(int, 2, 512))
def radial_gridding_reconstruct(kspace: Grid, trajectory: DataFrame, rows: int, cols: int) -> Grid:
    """Ramp-weighted linear gridding and an inverse transform that isn't scaled; sides are powers of two."""
    if rows & (rows - 1) or cols & (cols - 1):
        raise ShapeError("radial_gridding_reconstruct: sides must be powers of two")
    g = nufft.radial_linear_gridding2_adjoint(_with_trajectory(kspace, trajectory), (*kspace.keys, "channel"), rows, cols)
    return _coils_last(g, kspace.keys, kspace.shape[0])


@operator(NONCARTESIAN, "trajectory_correction", {"trajectory": TRAJECTORY}, {"trajectory": TRAJECTORY}, row_scale=Option(float, None, None, False, 1.0), col_scale=Option(float, None, None, False, 1.0), row_shift=Option(float, None, None, False, 0.0), col_shift=Option(float, None, None, False, 0.0))
def trajectory_correction(trajectory: DataFrame, row_scale: float = 1.0, col_scale: float = 1.0, row_shift: float = 0.0, col_shift: float = 0.0) -> DataFrame:
    """An affine correction of each axis."""
    return trajectory.withColumns({"k_row": F.col("k_row") * row_scale + row_shift, "k_col": F.col("k_col") * col_scale + col_shift})


@operator(NONCARTESIAN, "noncartesian_sense_reconstruct", {"kspace": SAMPLES, "trajectory": TRAJECTORY, "maps": MAPS}, {"image": PLANE}, iterations=Option(int, 1, 100, False, 10))
def noncartesian_sense_reconstruct(kspace: Grid, trajectory: DataFrame, maps: Grid, iterations: int = 10) -> Grid:
    """Conjugate gradients on the normal equations of all coils; one frame is a kernel's array."""
    rows, cols, coils = maps.shape
    n = kspace.shape[1]
    keys = kspace.keys
    if keys != maps.keys:
        raise ShapeError("samples and maps must have the same keys")
    lift = lambda df, kind, pos: df.select(*keys, F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), "re", "im")
    places = trajectory.select(*[F.col(k) for k in keys if k in trajectory.columns], F.col("sample").alias("s"), F.col("k_row").alias("re"), F.col("k_col").alias("im"))
    if set(keys) - set(trajectory.columns):
        places = kspace.frames().crossJoin(F.broadcast(places)) if not set(keys) & set(trajectory.columns) else places.join(kspace.frames(), [k for k in keys if k in trajectory.columns])
    all_parts = lift(kspace.df, 0, F.col("i0") * n + F.col("i1")).unionByName(lift(places.withColumnRenamed("s", "i1"), 1, F.col("i1"))).unionByName(lift(maps.df, 2, F.col("i2") * rows * cols + F.col("i0") * cols + F.col("i1")))
    sizes = [coils * n, n, coils * rows * cols]
    start = F.when(F.col("kind") == 0, F.lit(0)).when(F.col("kind") == 1, F.lit(sizes[0])).otherwise(F.lit(sizes[0] + sizes[1]))
    line = Grid(all_parts.select(*keys, (start + F.col("pos")).cast("int").alias("i0"), "re", "im"), (sum(sizes),), keys, True)

    def f(x: np.ndarray) -> np.ndarray:
        y = x[: sizes[0]].reshape(coils, n)
        k = x[sizes[0] : sizes[0] + n]
        s = x[sizes[0] + n :].reshape(coils, rows * cols)
        r, c = np.mgrid[0:rows, 0:cols]
        e = np.exp(-1j * (np.outer(k.real, r.ravel() - (rows - 1) / 2) + np.outer(k.imag, c.ravel() - (cols - 1) / 2)))
        normal = lambda v: sum(s[i].conj() * (e.conj().T @ (e @ (s[i] * v))) for i in range(coils))
        b = sum(s[i].conj() * (e.conj().T @ y[i]) for i in range(coils))
        v = np.zeros(rows * cols, complex)
        res = b.copy()
        p = res.copy()
        rr = np.vdot(res, res).real
        for _ in range(iterations):
            if rr < 1e-24:
                break
            q = normal(p)
            a = rr / np.vdot(p, q).real
            v, res = v + a * p, res - a * q
            rr, old = np.vdot(res, res).real, rr
            p = res + rr / old * p
        return v.reshape(rows, cols)

    return line.kernel(f, (rows, cols), True)


# ---------------------------------------------------------------- images
@operator(COMBINE, "coil_combine_rss", {"coil_images": COILS}, {"image": PICTURE})
def coil_combine_rss(coil_images: Grid) -> Grid:
    """The root of the coils' summed squares."""
    return arrays.root_sum_of_squares_across(coil_images, 2)


@operator(COMBINE, "coil_combine_adaptive", {"coil_images": COILS, "maps": MAPS}, {"image": PLANE})
def coil_combine_adaptive(coil_images: Grid, maps: Grid) -> Grid:
    """Sum of conj(map) x over the sum of |map|^2; 0 where that is 0."""
    both = coil_images.df.join(maps.df.withColumnsRenamed({"re": "s_re", "im": "s_im"}), [*[k for k in coil_images.keys if k in maps.keys], "i0", "i1", "i2"])
    re, im = cplx.multiply_conjugate(F.col("re"), F.col("im"), F.col("s_re"), F.col("s_im"))
    s = F.sum(F.col("s_re") * F.col("s_re") + F.col("s_im") * F.col("s_im"))
    df = both.groupBy(*coil_images.keys, "i0", "i1").agg(F.sum(re).alias("a"), F.sum(im).alias("b"), s.alias("s"))
    part = lambda c: F.when(F.col("s") > 0, F.col(c) / F.when(F.col("s") > 0, F.col("s"))).otherwise(0.0)
    return Grid(df.select(*coil_images.keys, "i0", "i1", part("a").alias("re"), part("b").alias("im")), coil_images.shape[:2], coil_images.keys, True)


@operator(IMAGE, "image_scale_float32", {"image": PICTURE}, {"image": PICTURE}, factor=Option(float))
def image_scale_float32(image: Grid, factor: float) -> Grid:
    return image.map(lambda v: v * factor)


@operator(IMAGE, "image_offset_float32", {"image": PICTURE}, {"image": PICTURE}, offset=Option(float))
def image_offset_float32(image: Grid, offset: float) -> Grid:
    return image.map(lambda v: v + offset)


@operator(IMAGE, "image_clamp_float32", {"image": PICTURE}, {"image": PICTURE}, minimum=Option(float), maximum=Option(float))
def image_clamp_float32(image: Grid, minimum: float, maximum: float) -> Grid:
    """Limited to [minimum, maximum]; not-a-number stays."""
    if minimum > maximum:
        raise ValueError("image_clamp_float32: minimum is above maximum")
    return image.map(lambda v: el.clamp(v, minimum, maximum))


@operator(IMAGE, "image_magnitude_float32", {"image": PLANE}, {"image": PICTURE})
def image_magnitude_float32(image: Grid) -> Grid:
    return image.map(cplx.magnitude)


@operator(IMAGE, "image_phase_float32", {"image": PLANE}, {"image": PICTURE})
def image_phase_float32(image: Grid) -> Grid:
    return image.map(cplx.phase)


@operator(IMAGE, "image_crop_float32", {"image": PICTURE}, {"image": PICTURE}, row=Option(int, 0), col=Option(int, 0), rows=Option(int, 1), cols=Option(int, 1))
def image_crop_float32(image: Grid, row: int, col: int, rows: int, cols: int) -> Grid:
    return arrays.crop(image, (row, col), (rows, cols))


@operator(IMAGE, "image_window_float32", {"image": PICTURE}, {"image": PICTURE}, minimum=Option(float), maximum=Option(float))
def image_window_float32(image: Grid, minimum: float, maximum: float) -> Grid:
    """Clamped to the window and put on [0, 1]."""
    return image.map(lambda v: (el.clamp(v, minimum, maximum) - minimum) / (maximum - minimum))


@operator(NORMALIZATION, "image_normalize", {"image": PICTURE}, {"image": PICTURE}, method=Option(str, required=False, default="max"))
def image_normalize(image: Grid, method: str = "max") -> Grid:
    """Each image by its largest value (max) or to zero mean and unit deviation (zscore); a zero divisor leaves 0."""
    agg = {"max": (F.lit(0.0), F.max("v")), "zscore": (F.avg("v"), F.stddev_pop("v"))}[method]
    s = image.df.groupBy(*image.keys).agg(agg[0].alias("base") if method == "zscore" else F.min(F.lit(0.0)).alias("base"), agg[1].alias("by"))
    df = image.df.join(s, list(image.keys)) if image.keys else image.df.crossJoin(F.broadcast(s))
    return replace(image, df=df.select(*image.keys, *image.index, F.when(F.col("by") != 0, (F.col("v") - F.col("base")) / F.when(F.col("by") != 0, F.col("by"))).otherwise(0.0).alias("v")))


@operator(QUALITY, "image_nonfinite_check", {"image": PICTURE}, {"image": PICTURE, "report": "image-quality-report"})
def image_nonfinite_check(image: Grid) -> dict:
    """The image as it is, and how many pixels aren't finite."""
    return {"image": image, "report": image.df.groupBy(*image.keys).agg(F.count_if(~el.isfinite(F.col("v"))).alias("nonfinite"), F.count("*").alias("pixels"))}


@operator(QUALITY, "image_range_check", {"image": PICTURE}, {"image": PICTURE, "report": "image-quality-report"}, minimum=Option(float), maximum=Option(float))
def image_range_check(image: Grid, minimum: float, maximum: float) -> dict:
    bad = F.isnan("v") | (F.col("v") < minimum) | (F.col("v") > maximum)
    return {"image": image, "report": image.df.groupBy(*image.keys).agg(F.count_if(bad).alias("outside"), F.count("*").alias("pixels"))}
