"""Linear algebra and Fourier transforms of stacks of small arrays.

The last axes (a matrix or a vector) are brought together for each place of
the leading axes.  Determinants, inverses, equations, triangular and orthogonal
factors, singular values and symmetric eigenvalues of real matrices are worked
out inside the JVM, powers and norms by joins and sums; for complex matrices
and general eigenvalues numpy works on all cells of an Arrow batch in one call.
One matrix or vector has to fit in a task; their number is free.  What the
whole table adds up to (least squares on many rows, principal components) goes
through small sums instead.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dtypes import dtype
from ..frame import NDFrame, idx, normal_axes
from ..storage import ready
from . import elimination, rotations
from .aggregates import vector_norm
from .cells import per_cell
from .contractions import matmul
from .fourier import fft, fft2, fftn, hfft, ifft, ifft2, ifftn, ihfft, irfft, irfft2, irfftn, rfft, rfft2, rfftn  # noqa: F401


def _square(x: NDFrame) -> int:
    if x.ndim < 2 or x.shape[-1] != x.shape[-2]:
        raise ValueError("the last two axes must be equal")
    return x.shape[-1]


def _same(x: NDFrame) -> str:
    return "complex128" if x.dtype.kind == "c" else "float64"


def inv(x: NDFrame) -> NDFrame:
    n = _square(x)
    return per_cell(np.linalg.inv, x, 2, (n, n), _same(x)) if x.dtype.kind == "c" else elimination.inv(x)


def det(x: NDFrame) -> NDFrame:
    _square(x)
    return per_cell(np.linalg.det, x, 2, (), _same(x)) if x.dtype.kind == "c" else elimination.det(x)


def slogdet(x: NDFrame) -> tuple[NDFrame, NDFrame]:
    _square(x)
    if x.dtype.kind != "c":
        return elimination.det(x, "sign"), elimination.det(x, "log")
    return per_cell(lambda m: np.linalg.slogdet(m)[0], x, 2, (), _same(x)), per_cell(lambda m: np.linalg.slogdet(m)[1], x, 2, ())


def cholesky(x: NDFrame, upper: bool = False) -> NDFrame:
    n = _square(x)
    if x.dtype.kind != "c":
        lower = elimination.cholesky(x)
        return lower.swapaxes(-1, -2) if upper else lower
    return per_cell(lambda m: np.linalg.cholesky(m, upper=upper), x, 2, (n, n), _same(x))


def qr(x: NDFrame) -> tuple[NDFrame, NDFrame]:
    """The thin factors; of complex matrices by numpy."""
    m, n = x.shape[-2:]
    if x.dtype.kind != "c":
        return rotations.qr(x)
    k = min(m, n)
    return per_cell(lambda a: np.linalg.qr(a)[0], x, 2, (m, k), _same(x)), per_cell(lambda a: np.linalg.qr(a)[1], x, 2, (k, n), _same(x))


def eigh(x: NDFrame) -> tuple[NDFrame, NDFrame]:
    """Rising eigenvalues and their vectors; of complex matrices by numpy."""
    n = _square(x)
    if x.dtype.kind != "c":
        return rotations.eigh(x)
    return per_cell(lambda a: np.linalg.eigh(a)[0], x, 2, (n,)), per_cell(lambda a: np.linalg.eigh(a)[1], x, 2, (n, n), _same(x))


def eigvalsh(x: NDFrame) -> NDFrame:
    _square(x)
    return rotations.eigvalsh(x) if x.dtype.kind != "c" else eigh(x)[0]


def eig(x: NDFrame) -> tuple[NDFrame, NDFrame]:
    n = _square(x)
    return per_cell(lambda a: np.linalg.eig(a)[0], x, 2, (n,), "complex128"), per_cell(lambda a: np.linalg.eig(a)[1], x, 2, (n, n), "complex128")


def eigvals(x: NDFrame) -> NDFrame:
    return eig(x)[0]


def svd(x: NDFrame) -> tuple[NDFrame, NDFrame, NDFrame]:
    """The thin factors; of complex matrices by numpy."""
    if x.dtype.kind != "c":
        return rotations.svd(x)
    m, n = x.shape[-2:]
    k = min(m, n)
    u = per_cell(lambda a: np.linalg.svd(a, full_matrices=False)[0], x, 2, (m, k), _same(x))
    return u, svdvals(x), per_cell(lambda a: np.linalg.svd(a, full_matrices=False)[2], x, 2, (k, n), _same(x))


def svdvals(x: NDFrame) -> NDFrame:
    if x.dtype.kind != "c":
        return rotations.svdvals(x)
    return per_cell(lambda a: np.linalg.svd(a, compute_uv=False), x, 2, (min(x.shape[-2:]),))


def pinv(x: NDFrame) -> NDFrame:
    if x.dtype.kind != "c":
        return rotations.pinv(x)
    m, n = x.shape[-2:]
    return per_cell(np.linalg.pinv, x, 2, (n, m), _same(x))


def matrix_rank(x: NDFrame) -> NDFrame:
    return rotations.matrix_rank(x) if x.dtype.kind != "c" else per_cell(np.linalg.matrix_rank, x, 2, ())


def matrix_power(x: NDFrame, n: int) -> NDFrame:
    """By squaring: each product is a join and a sum."""
    k = _square(x)
    if x.dtype.kind == "c":
        return per_cell(lambda a: np.linalg.matrix_power(a, n), x, 2, (k, k), _same(x))
    if n < 0:
        return matrix_power(inv(x), -n)
    unit = NDFrame(x.df.withColumn("v", F.when(x._i(x.ndim - 2) == x._i(x.ndim - 1), 1.0).otherwise(0.0)), x.shape)
    out, square = None, x.astype("float64")
    while n:
        if n & 1:
            out = square if out is None else matmul(out, square)
        n >>= 1
        if n:
            square = matmul(square, square)
    return unit if out is None else out


def cond(x: NDFrame, order=None) -> NDFrame:
    if order in (None, 2) and x.dtype.kind != "c":
        return rotations.cond(x)
    return per_cell(lambda a: np.linalg.cond(a, order), x, 2, ())


def matrix_norm(x: NDFrame, order="fro") -> NDFrame:
    """The norm of each matrix: Frobenius and the norms of rows and columns by sums, the others from singular values."""
    a, rows = abs(x), x.ndim - 2
    if order == "fro":
        return a.reduce(lambda v: F.sqrt(F.sum(v * v)), "float64", (rows, rows + 1))
    if order in (1, -1, float("inf"), -float("inf")):
        of = F.max if order > 0 else F.min
        return a.reduce(F.sum, axis=rows if abs(order) == 1 else rows + 1).reduce(of, "float64", rows)
    of = {"nuc": F.sum, 2: F.max, -2: F.min}[order]
    return svdvals(x).reduce(of, "float64", rows)


def norm(x: NDFrame, order=None, axis: int | tuple[int, int] | None = None, keepdims: bool = False) -> NDFrame:
    """Norms of vectors along one axis, of matrices along two, or of all elements; any order that either has."""
    if axis is None and (order is None or x.ndim not in (1, 2)):
        if order is not None:
            raise ValueError("a norm of this order needs one or two axes")
        return abs(x).reduce(lambda v: F.sqrt(F.sum(v.cast("double") * v)), "float64", None, keepdims)
    axes = normal_axes(axis, x.ndim)
    if len(axes) == 1:
        return abs(x).reduce(lambda v: vector_norm(v, 2 if order is None else order), "float64", axes, keepdims)
    if len(axes) != 2:
        raise ValueError("a norm has one axis or two")
    out = matrix_norm(x.moveaxis(axes, (x.ndim - 2, x.ndim - 1)), "fro" if order is None else order)
    return out.expand_dims(axes) if keepdims else out


def solve(a: NDFrame, b: NDFrame) -> NDFrame:
    """a x = b for stacks of matrices and vectors: the vectors ride along as a last column."""
    n = _square(a)
    lead = a.ndim - 2
    column = b.df.select(*idx(lead + 1), F.lit(n).cast("long").alias(f"i{lead + 1}"), F.col("v").cast("double").alias("v"))
    wide = NDFrame(a.astype("float64").df.unionByName(column), [*a.shape[:-1], n + 1])
    return elimination.solve(wide)


def lstsq(df: DataFrame, features: list[str], target: str, intercept: bool = True) -> dict[str, float]:
    """Least squares on any number of rows by a tall-skinny QR factorisation.

    Each task brings its rows, block by block, to a triangle of as many rows as
    there are columns, and triangles are stacked and factored again in levels of
    32, so the driver receives one: the condition of the columns isn't squared
    as it is by sums of products.  Rows with a null are left out; without rows
    the coefficients are 0.
    """
    ready(df.sparkSession)
    names = [*features, *(["intercept"] if intercept else [])]
    columns = [*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)), *([F.lit(1.0).alias("x_one")] if intercept else []), F.col(target).cast("double").alias("y")]
    n = len(columns)

    known = df.select(*columns).dropna()
    r = triangles(known, n)
    return dict(zip(names, np.linalg.lstsq(r[: n - 1, : n - 1], r[: n - 1, n - 1], rcond=None)[0].tolist()))


def triangles(known: DataFrame, n: int) -> np.ndarray:
    """The triangle of the QR factorisation of all rows of ``n`` float columns."""

    def triangle(m: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([m, np.zeros((n, n))]) if len(m) < n else m, mode="r")

    def made(batches):
        r = np.zeros((0, n))
        for batch in batches:
            r = triangle(np.vstack([r, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])]))
        yield pa.RecordBatch.from_pydict({"r": [r.reshape(-1).tolist()]}, pa.schema([("r", pa.list_(pa.float64()))]))

    def stacked(table: pa.Table) -> pa.Table:
        parts = [np.array(x, float).reshape(-1, n) for x in table["r"].to_pylist() if x]
        r = triangle(np.vstack(parts)) if parts else np.zeros((n, n))
        return pa.table({"part": [table["part"][0].as_py()], "r": pa.array([r.reshape(-1).tolist()], pa.list_(pa.float64()))})

    left = max(1, known.rdd.getNumPartitions())
    rows = known.mapInArrow(made, "r array<double>").select(F.spark_partition_id().cast("long").alias("part"), "r")
    while left:  # each level stacks the triangles of 32
        left = 0 if left <= 32 else -(-left // 32)
        rows = rows.withColumn("part", F.floor(F.col("part") / 32) if left else F.lit(0).cast("long")).groupBy("part").applyInArrow(stacked, "part long, r array<double>")
    got = [x["r"] for x in rows.collect()]
    return np.array(got[0], float).reshape(n, n) if got else np.zeros((n, n))


# Fourier transforms: see fourier.py


def fftshift(x: NDFrame, axes=None) -> NDFrame:
    axes = tuple(range(x.ndim)) if axes is None else (axes,) if isinstance(axes, int) else axes
    return x.roll([x.shape[a] // 2 for a in axes], axes)


def ifftshift(x: NDFrame, axes=None) -> NDFrame:
    axes = tuple(range(x.ndim)) if axes is None else (axes,) if isinstance(axes, int) else axes
    return x.roll([-(x.shape[a] // 2) for a in axes], axes)
