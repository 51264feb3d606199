"""Sparse matrices as rows (row, col, v): products are joins on the column, sums by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("none", "transpose", "conjugate_transpose")


def operation_rows(rows: int, cols: int, op: str) -> int:
    return rows if op == "none" else cols


def operation_cols(rows: int, cols: int, op: str) -> int:
    return cols if op == "none" else rows


def operate(a: DataFrame, op: str = "none") -> DataFrame:
    """The matrix, its transpose, or (with columns re, im) its conjugate transpose."""
    if op == "none":
        return a
    values = [c for c in ("v", "re", "im") if c in a.columns]
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), *[(-F.col(c)).alias(c) if c == "im" and op == "conjugate_transpose" else F.col(c) for c in values])


convert_csr = operate


def compact(a: DataFrame) -> DataFrame:
    """Repeated places summed."""
    return a.groupBy("row", "col").agg(F.sum("v").alias("v"))


def spmv(a: DataFrame, x: DataFrame, op: str = "none") -> DataFrame:
    """A x for x (i, x); rows without entries give none."""
    return operate(a, op).join(x, F.col("col") == F.col("i")).groupBy("row").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def spmm(a: DataFrame, b: DataFrame, op: str = "none") -> DataFrame:
    """op(A) B for a dense or sparse B (row, col, v)."""
    right = b.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("v").alias("w"))
    return operate(a, op).join(right, F.col("col") == F.col("k")).groupBy("row", F.col("j").alias("col")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def add(a: DataFrame, alpha: float, b: DataFrame, op: str = "none") -> DataFrame:
    """alpha op(A) + B."""
    left = operate(a, op).select("row", "col", (F.col("v") * F.lit(float(alpha))).alias("v"))
    return compact(left.unionByName(b.select("row", "col", "v")))


def _solved(n: int, row: np.ndarray, col: np.ndarray, v: np.ndarray, rhs: np.ndarray, lower: bool, unit: bool) -> np.ndarray:
    """Substitution for one system: a product of each row's entries with what is known by then."""
    at = row == col
    diag = np.ones(n) if unit else np.bincount(row[at], v[at], n)
    if (diag == 0).any():
        raise ValueError("triangular_solve: a diagonal element is 0")
    inside = (col < row) if lower else (col > row)
    row, col, v = row[inside], col[inside], v[inside]
    order = np.argsort(row, kind="stable")
    row, col, v = row[order], col[order], v[order]
    starts = np.searchsorted(row, np.arange(n + 1))
    x = np.zeros_like(rhs)
    for i in range(n) if lower else range(n - 1, -1, -1):
        part = slice(starts[i], starts[i + 1])
        x[i] = (rhs[i] - v[part] @ x[col[part]]) / diag[i]
    return x


def triangular_solve(a: DataFrame, b: DataFrame, keys: list[str], lower: bool = True, unit: bool = False) -> DataFrame:
    """keys, j, row, x: substitution for systems (keys, row, col, v) and right sides (keys, j, row, v), a system a task at a
    time: one system's entries must fit a task. Entries of the other triangle are left out; a zero diagonal is an error."""
    left = a.groupBy(*keys).agg(F.collect_list(F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))).alias("_left"))
    right = b.groupBy(*keys).agg(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), F.col("row").cast("long").alias("row"), F.col("v").cast("double").alias("v"))).alias("_right"))

    def parts(lists: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
        flat = lists.flatten()
        return lists.offsets.to_numpy() - lists.offsets[0].as_py(), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            ends_a, (row, col, v) = parts(batch.column(at("_left")), "row", "col", "v")
            ends_b, (j, place, w) = parts(batch.column(at("_right")), "j", "row", "v")
            for k in range(batch.num_rows):
                s, t = slice(ends_a[k], ends_a[k + 1]), slice(ends_b[k], ends_b[k + 1])
                n, cols = 1 + int(max(row[s].max(), place[t].max())), 1 + int(j[t].max())
                rhs = np.zeros((n, cols))
                np.add.at(rhs, (place[t], j[t]), w[t])
                x = _solved(n, row[s], col[s], v[s], rhs, lower, unit)
                own = [pa.array([batch.column(at(c))[k].as_py()] * x.size, batch.schema.field(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.tile(np.arange(cols, dtype=np.int32), n)), pa.array(np.repeat(np.arange(n, dtype=np.int32), cols)), pa.array(x.ravel())], names=[*keys, "j", "row", "x"])

    kinds = "".join(f"{k} {a.schema[k].dataType.simpleString()}, " for k in keys)
    return left.join(right, list(keys)).mapInArrow(run, f"{kinds}j int, row int, x double")


spsv = spsm = triangular_solve
