"""Matrices: products as joins and sums, factorisations as kernels on one packed matrix a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cplx
from tessera.grid import Grid, ShapeError, unpacked


def _pair(prefix: str, g: Grid):
    return (F.col(f"{prefix}re"), F.col(f"{prefix}im")) if g.is_complex else (F.col(f"{prefix}v"), F.lit(0.0))


def contract(a: Grid, b: Grid, a_dim: int, b_dim: int, conj_a: bool = False) -> Grid:
    """Sum over one axis of each; the axes left are a's, then b's. Keys that both have are matched."""
    if a.shape[a_dim] != b.shape[b_dim]:
        raise ShapeError(f"axes of {a.shape[a_dim]} and {b.shape[b_dim]} do not match")
    ka, kb = [d for d in range(a.rank) if d != a_dim], [d for d in range(b.rank) if d != b_dim]
    shared = [k for k in a.keys if k in b.keys]
    left = a.df.select(*a.keys, F.col(a.index[a_dim]).alias("k"), *[F.col(a.index[d]).alias(f"x{n}") for n, d in enumerate(ka)], *[F.col(c).alias(f"a_{c}") for c in a.values])
    right = b.df.select(*b.keys, F.col(b.index[b_dim]).alias("k"), *[F.col(b.index[d]).alias(f"y{n}") for n, d in enumerate(kb)], *[F.col(c).alias(f"b_{c}") for c in b.values])
    both = left.join(right, [*shared, "k"])
    keys = (*a.keys, *[k for k in b.keys if k not in shared])
    out = [f"x{n}" for n in range(len(ka))] + [f"y{n}" for n in range(len(kb))]
    if a.is_complex or b.is_complex:
        re_a, im_a = _pair("a_", a)
        re, im = cplx.multiply(re_a, -im_a if conj_a else im_a, *_pair("b_", b))
        aggs = [F.sum(re).alias("re"), F.sum(im).alias("im")]
    else:
        aggs = [F.sum(F.col("a_v") * F.col("b_v")).alias("v")]
    df = both.groupBy(*keys, *out).agg(*aggs)
    values = ["re", "im"] if len(aggs) == 2 else ["v"]
    df = df.select(*keys, *[F.col(c).alias(f"i{n}") for n, c in enumerate(out)], *values)
    return Grid(df, tuple([a.shape[d] for d in ka] + [b.shape[d] for d in kb]), keys, len(aggs) == 2)


#: Elements of a matrix up to which frames are multiplied whole, one a row.
PACKED = 1 << 20


def matmul(a: Grid, b: Grid) -> Grid:
    """A B of each frame. Frames that come packed are multiplied in stacks, with a join on their keys alone (none if both are
    one frame's); others, and large ones, by a join on the inner index and sums."""
    if a.shape[1] != b.shape[0]:
        raise ShapeError(f"{a.shape} by {b.shape}")
    if not a.keys or a.keys != b.keys or a.packed is None or b.packed is None or max(a.size, b.size) > PACKED:
        return contract(a, b, 1, 0)
    z = a.is_complex or b.is_complex
    if a is b:
        return a.kernel(lambda m: m @ m, (a.shape[0], b.shape[1]), z, True)
    both = a.pack().join(b.pack().withColumnsRenamed({c: f"r_{c}" for c in b.values}), list(a.keys))
    zeros = lambda c: F.transform(c, lambda x: x * 0.0)
    if z:
        re = F.concat(F.col("re") if a.is_complex else F.col("v"), F.col("r_re") if b.is_complex else F.col("r_v"))
        im = F.concat(F.col("im") if a.is_complex else zeros("v"), F.col("r_im") if b.is_complex else zeros("r_v"))
        df = both.select(*a.keys, re.alias("re"), im.alias("im"))
    else:
        df = both.select(*a.keys, F.concat("v", "r_v").alias("v"))
    n, (r, k), c = a.size, a.shape, b.shape[1]
    line = unpacked(df, (a.size + b.size,), a.keys, z)
    return line.kernel(lambda x: x[:, :n].reshape(-1, r, k) @ x[:, n:].reshape(-1, k, c), (r, c), z, True)


def gemv(a: Grid, x: Grid) -> Grid:
    return contract(a, x, 1, 0)


def hermitian_gram(a: Grid, scale: float = 1.0) -> Grid:
    """scale A^H A."""
    g = contract(a, a, 0, 0, conj_a=True)
    return g.map((lambda re, im: (re * scale, im * scale)) if g.is_complex else (lambda v: v * scale))


def dot(a: Grid, b: Grid) -> DataFrame:
    """Sum of conj(a) b."""
    both = a.zip(b, (lambda p, q, r, s: cplx.multiply_conjugate(r, s, p, q)) if a.is_complex else (lambda x, y: x * y))
    return both.df.groupBy(*a.keys).agg(*[F.sum(c).alias(c) for c in both.values])


def dotu(a: Grid, b: Grid) -> DataFrame:
    both = a.zip(b, cplx.multiply if a.is_complex else (lambda x, y: x * y))
    return both.df.groupBy(*a.keys).agg(*[F.sum(c).alias(c) for c in both.values])


def axpy(alpha: float, x: Grid, y: Grid) -> Grid:
    return x.zip(y, (lambda a, b, c, d: (a * alpha + c, b * alpha + d)) if x.is_complex else (lambda a, b: a * alpha + b))


def scale(x: Grid, s: float) -> Grid:
    return x.map((lambda re, im: (re * s, im * s)) if x.is_complex else (lambda v: v * s))


def diagonal_abs_sum(a: Grid) -> DataFrame:
    m = F.hypot("re", "im") if a.is_complex else F.abs(F.col("v"))
    return a.df.where("i0 = i1").groupBy(*a.keys).agg(F.sum(m).alias("total"))


def add_to_diagonal(a: Grid, value: float) -> Grid:
    c = a.values[0]
    return replace(a, df=a.df.withColumn(c, F.when(F.col("i0") == F.col("i1"), F.col(c) + value).otherwise(F.col(c))))


# ---------------------------------------------------------------- kernels on whole matrices
def per_matrix(a: Grid, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], out_complex: bool | None = None, batched: bool = True) -> Grid:
    """f on stacks of matrices, as NumPy's functions take them, or (not batched) on one matrix at a time."""
    return a.kernel(f, shape, a.is_complex if out_complex is None else out_complex, batched)


def inverse(a: Grid) -> Grid:
    return per_matrix(a, np.linalg.inv, a.shape)


def pseudo_inverse(a: Grid, tolerance: float = 1e-15) -> Grid:
    return per_matrix(a, lambda m: np.linalg.pinv(m, rcond=tolerance), a.shape[::-1])


def determinant(a: Grid) -> Grid:
    return per_matrix(a, lambda m: np.linalg.det(m)[:, None], (1,))


def singular_values(a: Grid) -> Grid:
    return per_matrix(a, lambda m: np.linalg.svd(m, compute_uv=False), (min(a.shape),), False)


def svd(a: Grid, full: bool = False) -> tuple[Grid, Grid, Grid]:
    """U, s, V^H."""
    r, c = a.shape
    k = min(a.shape)
    part = lambda n: (lambda m: np.linalg.svd(m, full_matrices=full)[n])
    return per_matrix(a, part(0), (r, r if full else k)), singular_values(a), per_matrix(a, part(2), (c if full else k, c))


def full_svd(a: Grid) -> tuple[Grid, Grid, Grid]:
    return svd(a, True)


def left_singular_vectors(a: Grid) -> Grid:
    return svd(a)[0]


def self_adjoint_eigenvalues(a: Grid) -> Grid:
    """Ascending."""
    return per_matrix(a, np.linalg.eigvalsh, (a.shape[0],), False)


def self_adjoint_eigenvectors(a: Grid) -> Grid:
    return per_matrix(a, lambda m: np.linalg.eigh(m)[1], a.shape)


def eigenvalues(a: Grid) -> Grid:
    """Complex, ordered by real part, then imaginary part."""
    return per_matrix(a, lambda m: np.sort_complex(np.linalg.eigvals(m).astype(complex)), (a.shape[0],), True, False)


def with_rhs(a: Grid, b: Grid) -> Grid:
    """[A | b] as one matrix, so that a kernel gets both."""
    n, cols = a.shape[1], 1 if b.rank == 1 else b.shape[1]
    if a.shape[0] != b.shape[0]:
        raise ShapeError("the right side must have a row for each row of the matrix")
    z = a.is_complex or b.is_complex
    lift = lambda g: g if g.is_complex == z else g.map(lambda v: (v, F.lit(0.0)))
    a, b = lift(a), lift(b)
    right = b.df.select(*b.keys, "i0", (F.lit(n) + (F.lit(0) if b.rank == 1 else F.col("i1"))).cast("int").alias("i1"), *b.values)
    return replace(a, df=a.df.unionByName(right), shape=(a.shape[0], n + cols))


def solver(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Grid, Grid], Grid]:
    def run(a: Grid, b: Grid) -> Grid:
        n = a.shape[1]
        shape = (n,) if b.rank == 1 else (n, b.shape[1])
        return with_rhs(a, b).kernel(lambda m: f(m[:, :n], m[:, n:]).reshape(shape), shape, a.is_complex or b.is_complex)

    return run


def _refined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.linalg.solve(a, b)
    for _ in range(2):
        x = x + np.linalg.solve(a, b - a @ x)
    return x


def _cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(a)
    return np.linalg.solve(low.conj().T, np.linalg.solve(low, b))


def _qr_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(a)
    return np.linalg.solve(r, q.conj().T @ b)


solve = solve_lu = solve_small = solver(np.linalg.solve)
solve_refined = solver(_refined)
solve_cholesky = solver(_cholesky_solve)
solve_qr = solver(_qr_solve)
solve_least_squares_svd = solver(lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0])
solve_normal_equations = solver(lambda a, b: np.linalg.solve(a.conj().T @ a, a.conj().T @ b))
LEAST_SQUARES = {"qr": solve_qr, "rank_revealing_qr": solve_least_squares_svd, "svd": solve_least_squares_svd, "normal_equations": solve_normal_equations, "normal_equations_cholesky": solver(lambda a, b: _cholesky_solve(a.conj().T @ a, a.conj().T @ b))}


def solve_least_squares(a: Grid, b: Grid, method: str = "qr") -> Grid:
    return LEAST_SQUARES[method](a, b)


def cholesky_lower(a: Grid) -> Grid:
    return per_matrix(a, np.linalg.cholesky, a.shape)


def tall_least_squares(a: Grid, b: Grid) -> Grid:
    """Least squares for a matrix of very many rows: A^H A and A^H b are sums over the rows, only their small system is a
    kernel."""
    gram, rhs = contract(a, a, 0, 0, conj_a=True), contract(a, b, 0, 0, conj_a=True)
    return solve(gram, rhs)


def whitening_from_covariance(c: Grid, floor: float = 1e-12) -> Grid:
    """V diag(1 / sqrt(max(eigenvalue, floor))) V^H."""

    def f(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        return (v / np.sqrt(np.maximum(w, floor))[:, None, :]) @ v.conj().swapaxes(1, 2)

    return per_matrix(c, f, c.shape)


whitening_matrix_from_covariance = whitening_from_covariance


def whiten_samples(samples: Grid, w: Grid) -> Grid:
    return matmul(samples, w)


def inverse_cholesky(c: Grid) -> Grid:
    return per_matrix(c, lambda m: np.linalg.inv(np.linalg.cholesky(m)), c.shape)


def apply_cholesky_prewhiten(inv: Grid, samples: Grid) -> Grid:
    return matmul(inv, samples)


def eigenvectors(a: Grid) -> Grid:
    """Columns in the order of eigenvalues(), each of unit norm with its largest element real and positive."""

    def f(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eig(m)
        v = v[:, np.lexsort((w.imag, w.real))].astype(complex)
        top = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
        return v * (np.abs(top) / top)

    return per_matrix(a, f, a.shape, True, False)


def cholesky_prewhiten_calibration(samples: Grid) -> tuple[Grid, DataFrame]:
    """From noise (channel, sample): the inverse lower Cholesky factor of the channels' sample covariance (means taken off,
    conj on the second), and mean, least and largest channel deviation (sigma)."""
    n = samples.shape[1]
    means = samples.df.groupBy(*samples.keys, "i0").agg(*[F.avg(c).alias(f"m_{c}") for c in samples.values])
    df = samples.df.join(means, [*samples.keys, "i0"])
    centred = replace(samples, df=df.select(*samples.keys, "i0", "i1", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in samples.values]))
    cov = contract(centred, centred, 1, 1, conj_a=True)
    cov = cov.map((lambda re, im: (re / (n - 1), -im / (n - 1))) if cov.is_complex else (lambda v: v / (n - 1)))
    sigma = F.sqrt(F.col(cov.values[0]))
    found = cov.df.where("i0 = i1").groupBy(*cov.keys).agg(F.avg(sigma).alias("sigma"), F.min(sigma).alias("least"), F.max(sigma).alias("largest"))
    return inverse_cholesky(cov), found


def downhill_simplex(initial: Grid, objective: Callable[[np.ndarray], float], lower, upper, tolerance: float = 1e8 * 2.220446049250313e-16, iterations: int = 10000) -> Grid:
    """The minimum of an objective from each vector of a grid, within bounds: Nelder-Mead by reflection, expansion,
    contraction and shrinking."""
    lo, hi = np.asarray(lower, float), np.asarray(upper, float)

    def descend(x: np.ndarray) -> np.ndarray:
        n = len(x)
        clip = lambda p: np.minimum(np.maximum(p, lo), hi)
        points = [clip(x)]
        for d in range(n):
            p = x.copy()
            p[d] = p[d] * 1.05 if p[d] else 0.00025
            points.append(clip(p))
        values = [objective(p) for p in points]
        for _ in range(iterations):
            order = np.argsort(values, kind="stable")
            points, values = [points[i] for i in order], [values[i] for i in order]
            if 2 * abs(values[-1] - values[0]) <= tolerance * (abs(values[-1]) + abs(values[0])) + 1e-300:
                break
            centre = np.mean(points[:-1], axis=0)
            mirror = clip(2 * centre - points[-1])
            v = objective(mirror)
            if values[0] <= v <= values[-2]:
                points[-1], values[-1] = mirror, v
                continue
            if v < values[0]:
                far = clip(mirror + (mirror - centre))
                w = objective(far)
                points[-1], values[-1] = (far, w) if w < v else (mirror, v)
                continue
            near = clip(centre + 0.5 * (points[-1] - centre))
            w = objective(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [clip(points[0] + 0.5 * (p - points[0])) for p in points[1:]]
                values = [values[0]] + [objective(p) for p in points[1:]]
        return points[int(np.argmin(values))]

    def f(x: np.ndarray) -> np.ndarray:
        # a simplex pressed flat against a bound stops early: begin anew from its best point while that helps
        best = descend(x)
        for _ in range(8):
            again = descend(best)
            if objective(best) - objective(again) <= tolerance * abs(objective(best)):
                break
            best = again
        return again

    return initial.kernel(f, initial.shape)


# ---------------------------------------------------------------- small fixed matrices, as expressions
def rotation(axis: str, angle: float) -> np.ndarray:
    """3 x 3 about x, y or z."""
    c, s = np.cos(angle), np.sin(angle)
    return {"x": np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), "y": np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), "z": np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])}[axis]


def matrix_times_point(m: np.ndarray, *point):
    """Columns of m p for a fixed small m."""
    out = []
    for row in m:
        e = F.lit(0.0)
        for a, p in zip(row, point, strict=True):
            e = e + F.lit(float(a)) * p
        out.append(e)
    return tuple(out)


def point_times_matrix(m: np.ndarray, *point):
    return matrix_times_point(np.asarray(m).T, *point)
