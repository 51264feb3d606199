"""Dense arrays of rank 1 to 4 as DataFrames: one row an element (long form) or one row an array (packed form).

Long form: key columns, index columns i0, i1, ... from 0, and v (real) or re and im (complex). Linear operators are joins
and sums over it, pointwise ones column expressions, so Catalyst plans them. Packed form: keys and array columns in
row-major order, for kernels that factorise or iterate (NumPy over Arrow, one array of bounded size a row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ShapeError(ValueError):
    """Operands do not have the shapes that an operator asks for."""


def index_names(rank: int) -> list[str]:
    return [f"i{d}" for d in range(rank)]


@dataclass(frozen=True)
class Grid:
    """Arrays of one shape, an array for each value of the keys."""

    df: DataFrame
    shape: tuple[int, ...]
    keys: tuple[str, ...] = ()
    is_complex: bool = False
    #: the packed form, where df comes from it unchanged: kernels then need no shuffle. replace() forgets it.
    packed: DataFrame | None = field(default=None, init=False, compare=False)

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def index(self) -> list[str]:
        return index_names(self.rank)

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.is_complex else ["v"]

    @property
    def size(self) -> int:
        return int(np.prod(self.shape)) if self.shape else 1

    def linear(self) -> Column:
        """The row-major position of an element."""
        out = F.lit(0)
        for name, n in zip(self.index, self.shape, strict=True):
            out = out * n + F.col(name)
        return out

    # ------------------------------------------------------------ pointwise
    def map(self, f: Callable[..., Column], out_complex: bool | None = None) -> Grid:
        """f(v), or f(re, im); it gives a Column, or a pair for complex results."""
        got = f(*[F.col(c) for c in self.values])
        pair = isinstance(got, tuple)
        cols = [got[0].alias("re"), got[1].alias("im")] if pair else [got.alias("v")]
        return replace(self, df=self.df.select(*self.keys, *self.index, *cols), is_complex=pair)

    def zip(self, other: Grid, f: Callable[..., Column]) -> Grid:
        """f over the elements of two grids of equal shape and keys; an element that only one has is an error."""
        if self.shape != other.shape:
            raise ShapeError(f"shapes {self.shape} and {other.shape} differ")
        on = [*self.keys, *self.index] if set(self.keys) == set(other.keys) else self.index + [k for k in self.keys if k in other.keys]
        renamed = other.df.select(*on, *[F.col(c).alias(f"r_{c}") for c in other.values])
        both = self.df.withColumn("l_has", F.lit(True)).join(renamed.withColumn("r_has", F.lit(True)), on, "full_outer")
        fail = F.raise_error(F.lit("an element is missing in one of the operands")).cast("double")
        whole = F.col("l_has") & F.col("r_has")
        sure = lambda c: F.when(whole, F.col(c)).otherwise(fail)
        got = f(*[sure(c) for c in self.values], *[sure(f"r_{c}") for c in other.values])
        pair = isinstance(got, tuple)
        cols = [got[0].alias("re"), got[1].alias("im")] if pair else [got.alias("v")]
        return replace(self, df=both.select(*self.keys, *self.index, *cols), is_complex=pair)

    # ------------------------------------------------------------ indexes
    def reindex(self, shape: tuple[int, ...], where: Column | None, *exprs: Column) -> Grid:
        """Rows where a condition holds, with new indexes."""
        df = self.df if where is None else self.df.where(where)
        return replace(self, df=df.select(*self.keys, *[e.cast("int").alias(n) for e, n in zip(exprs, index_names(len(shape)), strict=True)], *self.values), shape=tuple(shape))

    def frames(self) -> DataFrame:
        """The keys, once each."""
        return self.df.select(*self.keys).distinct() if self.keys else self.df.sparkSession.range(1).select()

    def filled(self, shape: tuple[int, ...], background: float = 0.0) -> Grid:
        """All elements of `shape` for each key: those of the grid, else the background."""
        every = self.frames()
        for name, n in zip(index_names(len(shape)), shape, strict=True):
            every = every.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        df = every.join(self.df, [*self.keys, *index_names(len(shape))], "left")
        fill = [F.coalesce(F.col(c), F.lit(background if c != "im" else 0.0)).alias(c) for c in self.values]
        return replace(self, df=df.select(*self.keys, *index_names(len(shape)), *fill), shape=tuple(shape))

    # ------------------------------------------------------------ packed form
    def pack(self) -> DataFrame:
        """keys and one array<double> column for each value column, in row-major order; a missing element is an error."""
        if self.packed is not None:
            n = F.size(self.values[0])
            whole = lambda c: F.when(n == self.size, F.col(c)).otherwise(F.raise_error(F.lit(f"an array does not have the {self.size} elements of its shape")).cast("array<double>"))
            return self.packed.select(*self.keys, *[whole(c).alias(c) for c in self.values])
        rows = self.df.select(*self.keys, F.struct(self.linear().alias("lin"), *self.values).alias("e"))
        packed = rows.groupBy(*self.keys).agg(F.array_sort(F.collect_list("e")).alias("e"))
        whole = F.when(F.size("e") == self.size, F.col("e")).otherwise(F.raise_error(F.lit(f"an array does not have the {self.size} elements of its shape")).cast("array<struct<lin:int,v:double>>" if not self.is_complex else "array<struct<lin:int,re:double,im:double>>"))
        return packed.select(*self.keys, whole.alias("e")).select(*self.keys, *[F.col(f"e.{c}").alias(c) for c in self.values])

    def kernel(self, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], out_complex: bool = False, batched: bool = False, masked: bool = False) -> Grid:
        """f on each array (complex128 or float64), whose results have the given shape; batched: on stacks of arrays; masked:
        on stacks in which nulls are masked (else they are NaN), and what the results mask becomes null."""
        packed = self.pack()
        keys, values, inner, is_complex = self.keys, self.values, self.shape, self.is_complex
        names = ["re", "im"] if out_complex else ["v"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index
                cells = [batch.column(at(c)).flatten() for c in values]
                parts = [x.to_numpy(zero_copy_only=False).reshape(-1, *inner) for x in cells]
                data = parts[0] + 1j * parts[1] if is_complex else parts[0]
                if masked:
                    data = np.ma.MaskedArray(data, np.any([x.is_null().to_numpy(zero_copy_only=False) for x in cells], axis=0).reshape(data.shape))
                out = np.asanyarray(f(data)) if (batched or masked) and len(data) else np.array([f(x) for x in data])
                null = np.ma.getmaskarray(out).ravel() if masked else None
                out = np.ma.getdata(out).reshape(len(data), *shape)
                flat = [np.ascontiguousarray(out.imag if c == "im" else out.real, float).ravel() for c in names]
                starts = pa.array(np.arange(len(data) + 1, dtype=np.int32) * (out[0].size if len(data) else 0))
                cols = [pa.ListArray.from_arrays(starts, pa.array(x, mask=null)) for x in flat]
                yield pa.RecordBatch.from_arrays([*[batch.column(at(k)) for k in keys], *cols], names=[*keys, *names])

        schema = T.StructType([*[packed.schema[k] for k in keys], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]])
        return unpacked(packed.mapInArrow(run, schema), shape, keys, out_complex)


def unpacked(df: DataFrame, shape: tuple[int, ...], keys: tuple[str, ...] = (), is_complex: bool = False) -> Grid:
    """The long form of packed rows."""
    names = ["re", "im"] if is_complex else ["v"]
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("lin", "e"))
    exprs, step = [], int(np.prod(shape)) if shape else 1
    for n, name in zip(shape, index_names(len(shape)), strict=True):
        step //= n
        exprs.append(F.pmod(F.floor(F.col("lin") / F.lit(step)), F.lit(n)).cast("int").alias(name))
    out = Grid(rows.select(*keys, *exprs, *[F.col(f"e.{c}").alias(c) for c in names]), tuple(shape), tuple(keys), is_complex)
    object.__setattr__(out, "packed", df.select(*keys, *names))
    return out


def from_arrays(df: DataFrame, column: str, shape: tuple[int, ...], keys: tuple[str, ...]) -> Grid:
    """A grid from an array column that holds the elements in row-major order."""
    return unpacked(df.select(*keys, F.transform(F.col(column), lambda x: x.cast("double")).alias("v")), shape, keys)


def from_numpy(spark: SparkSession, data: np.ndarray) -> Grid:
    """One array, as a keyless grid."""
    data = np.asarray(data)
    z = np.iscomplexobj(data)
    flat = np.ascontiguousarray(data).ravel()
    row = (flat.real.astype(float).tolist(), flat.imag.astype(float).tolist()) if z else (flat.astype(float).tolist(),)
    return unpacked(spark.createDataFrame([row], "re array<double>, im array<double>" if z else "v array<double>"), data.shape, (), z)


def to_numpy(grid: Grid) -> np.ndarray:
    """The array of a keyless grid, on the driver: for results known to be small."""
    out = np.zeros(grid.shape, complex if grid.is_complex else float)
    for r in grid.df.collect():
        out[tuple(r[n] for n in grid.index)] = complex(r.re, r.im) if grid.is_complex else r.v
    return out


def constants(spark: SparkSession, shape: tuple[int, ...], value: Callable[..., Column]) -> Grid:
    """A keyless grid whose elements are an expression of their indexes."""
    n = int(np.prod(shape)) if shape else 1
    df, exprs, step = spark.range(n), [], n
    for d, name in zip(shape, index_names(len(shape)), strict=True):
        step //= d
        exprs.append(F.pmod(F.floor(F.col("id") / F.lit(step)), F.lit(d)).cast("int").alias(name))
    df = df.select("id", *exprs)
    got = value(F.col("id"), *[F.col(n) for n in index_names(len(shape))])
    cols = [got[0].alias("re"), got[1].alias("im")] if isinstance(got, tuple) else [got.cast("double").alias("v")]
    return Grid(df.select(*index_names(len(shape)), *cols), tuple(shape), (), isinstance(got, tuple))


def union(grids: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, grids)
