"""Every operation by its public name, in groups: what a caller who knows a name looks it up by.

Names that differ only by where results go (in place, into a workspace, by components) are the same operation here, as
DataFrames never change; they are listed with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from tessera import diagnostics, grid
from tessera.functions import cplx, elementwise, special, windows
from tessera.operators import arrays, fft, image, linalg, nufft, raster, signal, sparse, stats
from tessera.sources import formats


def public(module) -> dict[str, Callable]:
    return {n: f for n, f in vars(module).items() if callable(f) and not n.startswith("_") and getattr(f, "__module__", "").startswith("tessera")}


def _same(x):
    return x


RANKS = {"vector": 1, "matrix": 2, "image": 2, "cube": 3, "array4d": 4}


def _sized(maker: Callable, rank: int) -> Callable:
    """A constructor that takes the sizes one by one."""

    def build(spark, *args, **more):
        return maker(spark, tuple(args[:rank]), *args[rank:], **more)

    return build


ARRAY = public(elementwise) | public(cplx) | public(arrays)
ARRAY |= {f"{n}_{kind}": _sized(f, rank) for n, f in (("full", arrays.full), ("zeros", arrays.zeros), ("ones", arrays.ones), ("linspace", arrays.linspace), ("uniform_random", arrays.uniform_random)) for kind, rank in RANKS.items()}
ARRAY |= {f"make_pooled_{kind}": _sized(arrays.zeros, rank) for kind, rank in RANKS.items()}
ARRAY |= {f"{kind}_view": _same for kind in RANKS} | {"as_const_view": _same, "copy_as_matrix": _same, "copy_as_image": _same}
ARRAY |= {
    "identity_matrix": arrays.identity, "eye_matrix": arrays.eye, "abs": elementwise.absolute, "dim_index": lambda name: int(name.removeprefix("dim")),
    "fill_linspace": lambda g, start, stop: g.map(lambda *_: F.lit(float(start)) + g.linear() * F.lit((stop - start) / max(g.size - 1, 1))),
    "fill_uniform_random": lambda g, lower, upper, seed=0: g.map(lambda *_: F.lit(float(lower)) + F.pmod(F.xxhash64(*[F.col(k) for k in g.keys], g.linear(), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) * F.lit(float(upper - lower))),
    "contiguous_span": grid.Grid.pack, "try_contiguous_span": lambda g: g.packed, "pack_contiguous": grid.Grid.pack, "swap": lambda a, b: (b, a), "transform": grid.Grid.map,
    "for_each_linear_indexed": arrays.for_each, "for_each_indexed": arrays.for_each, "flatten_view": arrays.ravel, "reshape_view": arrays.reshape, "slice": arrays.slice_axis,
    "sum": lambda g, dim=None: stats.total(g) if dim is None else arrays.sum_axis(g, dim), "min": lambda g, dim=None: stats.min_max(g) if dim is None else arrays.min_axis(g, dim),
    "max": lambda g, dim=None: stats.min_max(g) if dim is None else arrays.max_axis(g, dim), "argmin": lambda g, dim=None: stats.min_index(g) if dim is None else arrays.argmin_axis(g, dim),
    "argmax": lambda g, dim=None: stats.max_index(g) if dim is None else arrays.argmax_axis(g, dim), "reduce_extreme": arrays.reduce_axis, "reduce_extreme_index": lambda g, dim, largest=False: (arrays.argmax_axis if largest else arrays.argmin_axis)(g, dim),
    "max_element": stats.extremes, "min_element": stats.extremes, "minmax": stats.min_max, "mean": stats.mean, "norm": stats.norm, "squared_norm": stats.squared_norm, "sum_abs": stats.sum_abs, "squared_distance": stats.squared_distance,
    "all_close": stats.all_close, "count_nonzero": stats.count_nonzero, "all_of": stats.all_of, "any_of": stats.any_of, "accumulate_if": stats.accumulate_if,
    "complex_unit_phasor_and_accumulate_conjugate_product": lambda re, im, ar, ai, sr, si, eps=0.0, s=1.0: (p := cplx.complex_unit_phasor(re, im, eps), cplx.accumulate_conjugate_product_scaled(ar, ai, *p, sr, si, s)),
    "complex_unit_phasor_and_accumulate_conjugate_product_divided": lambda re, im, ar, ai, sr, si, d, eps=0.0: (p := cplx.complex_unit_phasor(re, im, eps), cplx.accumulate_conjugate_product_divided(ar, ai, *p, sr, si, d)),
}
for _n in ("normalize_complex_phase", "fftshift", "ifftshift", "reverse", "rotate_left", "lerp", "decimate_blocks", "bitwise_and", "bitwise_not", "multiply_array4d_by_cube", "multiply_cube_by_abs_sum_squared"):
    ARRAY[f"{_n}_in_place"] = ARRAY[_n]
ARRAY |= {"bitwise_and_inplace": elementwise.bitwise_and, "bitwise_not_inplace": elementwise.bitwise_not}

FOURIER = public(fft) | {"fftshift": arrays.fftshift, "ifftshift": arrays.ifftshift, "fftshift_in_place": arrays.fftshift, "ifftshift_in_place": arrays.ifftshift}
FOURIER |= {f"{op}2d_{mode}_fft": partial(f, mode=mode) for op, f in (("convolve", fft.convolve2d_fft), ("correlate", fft.correlate2d_fft)) for mode in ("full", "same", "valid")}
FOURIER |= {f"{n}_inplace": FOURIER[n] for n in ("fft", "ifft", "fft_segmented", "fft2", "ifft2")}
FOURIER |= {
    "fft2_inplace_with_workspace": fft.fft2, "ifft3_batch": partial(fft.fft3_batch, inverse=True), "fft3_volume_batch": fft.fft3_batch, "ifft3_volume_batch": partial(fft.fft3_batch, inverse=True),
    "fft3_centered_volume_batch_in_place_input": lambda g, norm="inverse": fft.transform(g, (0, 1, 2), False, norm, True), "ifft3_centered_volume_batch_in_place_input": lambda g, norm="inverse": fft.transform(g, (0, 1, 2), True, norm, True),
    "dim_from_fft_mode": lambda mode: {1: 0, 2: 1, 3: 2}[mode],
}

LINALG = public(linalg) | {
    "transpose": arrays.transpose, "transpose_rotated_180": arrays.transpose_rotated_180, "squared_norm": stats.squared_norm, "norm_l2": stats.norm_l2,
    "self_adjoint_eigen_decomposition": lambda a: (linalg.self_adjoint_eigenvalues(a), linalg.self_adjoint_eigenvectors(a)), "eigen_decomposition": lambda a: (linalg.eigenvalues(a), linalg.eigenvectors(a)),
    "identity_matrix3": lambda: np.eye(3), "rotation_x": partial(linalg.rotation, "x"), "rotation_y": partial(linalg.rotation, "y"), "rotation_z": partial(linalg.rotation, "z"), "multiply": linalg.matmul,
    "pseudo_inverse_4x2": linalg.pseudo_inverse, "least_squares_4x2": linalg.solve_least_squares, "try_solve_refined": linalg.solve_refined,
    "svd_in_place": linalg.svd, "full_svd_in_place": linalg.full_svd, "least_squares": linalg.solve_least_squares,
}
LINALG |= {"self_adjoint_eigen_decomposition_with_workspace": LINALG["self_adjoint_eigen_decomposition"], "whitening_matrix_from_self_adjoint_eigen_with_workspace": linalg.whitening_from_covariance}

IMAGE = public(image) | public(raster) | {f"cwise_{n}": (lambda a, b, f=f: a.zip(b, f)) for n, f in (("add", elementwise.add), ("subtract", elementwise.subtract), ("multiply", elementwise.multiply), ("divide", elementwise.divide))}
IMAGE |= {f"cwise_{n}_scalar": (lambda a, s, f=f: a.map(lambda v: f(v, s))) for n, f in (("add", elementwise.add), ("subtract", elementwise.subtract), ("multiply", elementwise.multiply), ("divide", elementwise.divide))}
IMAGE |= {f"cwise_{n}": (lambda a, f=f: a.map(f)) for n, f in (("abs", elementwise.absolute), ("square", elementwise.square), ("sqrt", elementwise.sqrt))}
IMAGE |= {f"resize_{k}": partial(image.resize, kind=k) for k in ("nearest", "linear", "cubic", "area", "lanczos4")}
IMAGE |= {
    "copy": arrays.copy, "fill": arrays.fill, "crop": arrays.crop, "minmax": stats.min_max, "mean": stats.mean, "mean_stddev": stats.mean_stddev, "norm_l1": stats.norm_l1, "norm_l2": stats.norm_l2, "norm_inf": stats.norm_inf,
    "norm_diff_l1": stats.norm_diff_l1, "norm_diff_l2": stats.norm_diff_l2, "norm_diff_inf": stats.norm_diff_inf, "otsu_threshold": stats.otsu_threshold, "multi_otsu_thresholds_scaled_inplace": image.multi_otsu_thresholds_scaled,
    "cubic_interpolate_2d_inplace": partial(image.resample_axis, kind="cubic"), "filter3d_replicate_in_place": image.filter3d_replicate, "dilate_mask_in_place": image.dilate_mask, "erode_mask_in_place": image.erode_mask, "write_image": formats.write_pgm,
}

SIGNAL = public(signal) | public(windows) | {"window": signal.window, "extract_sliding_window_matrix": arrays.extract_sliding_window_matrix, "correlate2d_same_fft": partial(fft.correlate2d_fft, mode="same"), "median_filter_in_place": signal.median_filter}
NUFFT = public(nufft)
SPARSE = public(sparse) | {"make_csr_plan": lambda coo, parts: coo.repartition(parts, "col")}
SPECIAL = {n: f for n, f in vars(special).items() if callable(f) and not n.startswith("_")} | {"sqrt": elementwise.sqrt, "conj": cplx.conj, "abs": cplx.magnitude, "arg": cplx.arg}
STATISTICS = public(stats) | {"sum": stats.total, "max_value": stats.min_max, "min_value": stats.min_max, "covariance_channel_major_with_workspace": lambda g: linalg.contract(g, g, 1, 1, conj_a=True)}
SCALAR = {n: getattr(elementwise, n) for n in ("abs_value", "order", "floor_mod", "floor_mod_fix", "round_value")}
FILES = public(formats) | public(diagnostics) | {f"{way}_{kind}": getattr(formats, f"{way}_array") for way in ("read", "write") for kind in ("vector", "matrix", "cube", "array4d")}
FILES |= {"debug_view": _same, "append_debug_jsonl": formats.append_jsonl, "format_layout": lambda g: str(diagnostics.describe_layout(g)), "format_summary": diagnostics.format_row, "format_comparison": diagnostics.format_row}

CATALOG: dict[str, dict[str, Callable]] = {"array": ARRAY, "fourier": FOURIER, "linalg": LINALG, "image": IMAGE, "signal": SIGNAL, "nufft": NUFFT, "sparse": SPARSE, "special": SPECIAL, "statistics": STATISTICS, "scalar": SCALAR, "files": FILES}


def find(name: str) -> list[Callable]:
    """The operations of a name, of each group that has it."""
    return [ops[name] for ops in CATALOG.values() if name in ops]
