"""Products that sum over shared axes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame, normal_axes
from ..functions import complexes as C
from ..plans.einsum import einsum
from ..storage import BROADCAST_BYTES

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Partitions of a product's blocks at most.
PIECES = 1024


def matmul(a: NDFrame, b: NDFrame) -> NDFrame:
    """The matrix product over the last axis of a and the last but one of b; leading axes are broadcast."""
    if not a.ndim or not b.ndim:
        raise ValueError("matmul needs arrays of one axis at least")
    x, y = (a.expand_dims(0) if a.ndim == 1 else a), (b.expand_dims(1) if b.ndim == 1 else b)
    out = einsum("...ij,...jk->...ik", x, y)
    if a.ndim == 1:
        out = out.squeeze(out.ndim - 2)
    return out.squeeze(out.ndim - 1) if b.ndim == 1 else out


def tensordot(a: NDFrame, b: NDFrame, axes: int | tuple = 2) -> NDFrame:
    own, others = (list(range(a.ndim - axes, a.ndim)), list(range(axes))) if isinstance(axes, int) else (normal_axes(axes[0], a.ndim), normal_axes(axes[1], b.ndim))
    left = list(_LETTERS[: a.ndim])
    right = list(_LETTERS[a.ndim : a.ndim + b.ndim])
    for i, j in zip(own, others):
        right[j] = left[i]
    out = "".join([c for k, c in enumerate(left) if k not in own] + [c for k, c in enumerate(right) if k not in others])
    return einsum(f"{''.join(left)},{''.join(right)}->{out}", a, b)


def dot(a: NDFrame, b: NDFrame) -> NDFrame:
    if not a.ndim or not b.ndim:
        return a * b
    return tensordot(a, b, ((a.ndim - 1,), (max(0, b.ndim - 2),)))


def inner(a: NDFrame, b: NDFrame) -> NDFrame:
    return tensordot(a, b, ((a.ndim - 1,), (b.ndim - 1,)))


def _conjugate(a: NDFrame) -> NDFrame:
    return a.map(C.conjugate) if a.dtype.kind == "c" else a


def vdot(a: NDFrame, b: NDFrame) -> NDFrame:
    return einsum("i,i->", _conjugate(a.ravel()), b.ravel())


def vecdot(a: NDFrame, b: NDFrame) -> NDFrame:
    return einsum("...i,...i->...", _conjugate(a), b)


def matvec(a: NDFrame, b: NDFrame) -> NDFrame:
    return einsum("...ij,...j->...i", a, b)


def vecmat(a: NDFrame, b: NDFrame) -> NDFrame:
    return einsum("...i,...ij->...j", _conjugate(a), b)


def outer(a: NDFrame, b: NDFrame) -> NDFrame:
    return a.ravel().expand_dims(1) * b.ravel()


def kron(a: NDFrame, b: NDFrame) -> NDFrame:
    """Each value of a times all of b, as blocks."""
    n = max(a.ndim, b.ndim)
    x, y = (z.reshape([1] * (n - z.ndim) + list(z.shape)) for z in (a, b))
    wide = x.reshape([s for k in range(n) for s in (x.shape[k], 1)]) * y.reshape([s for k in range(n) for s in (1, y.shape[k])])
    return wide.reshape([s * t for s, t in zip(x.shape, y.shape)])


def cross(a: NDFrame, b: NDFrame) -> NDFrame:
    """Of vectors of length 3 along the last axis."""
    if a.shape[-1] != 3 or b.shape[-1] != 3:
        raise ValueError("cross needs vectors of length 3")
    turn = lambda x, k: x.roll(k, x.ndim - 1)
    return turn(a, -1) * turn(b, -2) - turn(a, -2) * turn(b, -1)


def trace(a: NDFrame, k: int = 0) -> NDFrame:
    d = a.diagonal(k)
    return d.reduce(F.sum, axis=d.ndim - 1)


def gram(df: DataFrame, column: str, width: int) -> NDFrame:
    """X^T X of the rows of an array column: each task adds up its own width x width part.

    Only one matrix a task is shuffled, whatever the number of rows.
    """

    def made(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0)
            x = x.filter(x.is_valid())
            m = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            total += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_pydict({"i0": pa.array(i, pa.int64()), "i1": pa.array(j, pa.int64()), "v": total.ravel()})

    parts = df.select(column).mapInArrow(made, "i0 long, i1 long, v double")
    return NDFrame(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (width, width))


def blocked_matmul(a: NDFrame, b: NDFrame, block: int = 256) -> NDFrame:
    """The product of two large dense matrices by blocks: numpy multiplies pairs of blocks, Spark joins and adds them.

    An element goes over the network once for each block of the other matrix
    that it meets, in place of once for each element.  Where the sum is over
    one block, a product is a whole part of the result and isn't shuffled; a
    second matrix of BROADCAST_BYTES at most goes to the tasks as a whole.
    """
    (m, k), (_, n) = a.shape, b.shape

    def cut(x: NDFrame, row: str, col: str) -> DataFrame:
        at = x.df.select(F.floor(F.col("i0") / block).cast("int").alias(row), F.floor(F.col("i1") / block).cast("int").alias(col), (F.col("i0") % block).cast("int").alias("i"), (F.col("i1") % block).cast("int").alias("j"), F.col("v").cast("double").alias("v"))
        rows, columns = x.shape

        def pack(key, t):
            r, c = key[0].as_py(), key[1].as_py()
            out = np.zeros((min(block, rows - r * block), min(block, columns - c * block)))
            out[t["i"].to_numpy(), t["j"].to_numpy()] = t["v"].to_numpy()
            return pa.table({row: pa.array([r], pa.int32()), col: pa.array([c], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

        return at.groupBy(row, col).applyInArrow(pack, f"{row} int, {col} int, data binary")

    def product(q, x, y):
        shared = min(block, k - q.as_py() * block)
        return np.frombuffer(x.as_buffer(), float).reshape(-1, shared) @ np.frombuffer(y.as_buffer(), float).reshape(shared, -1)

    def cells(r, c, v):
        i, j = np.divmod(np.arange(v.size), min(block, n - c * block))
        return {"i0": pa.array(i + r * block, pa.int64()), "i1": pa.array(j + c * block, pa.int64()), "v": pa.array(v.reshape(-1))}

    def multiply(batches):
        for t in batches:
            products = [product(*x).tobytes() for x in zip(t["q"], t["data"], t["other"])]
            yield pa.RecordBatch.from_arrays([t["r"], t["c"], pa.array(products, pa.binary())], ["r", "c", "data"])

    def whole(batches):
        for t in batches:
            for r, c, *x in zip(t["r"], t["c"], t["q"], t["data"], t["other"]):
                yield pa.RecordBatch.from_pydict(cells(r.as_py(), c.as_py(), product(*x)))

    def add(key, t):
        total = 0.0
        for x in t["data"]:
            total = total + np.frombuffer(x.as_buffer(), float)
        return pa.table(cells(key[0].as_py(), key[1].as_py(), total))

    left, right = cut(a, "r", "q"), cut(b, "q", "c").withColumnRenamed("data", "other")
    if 8 * k * n <= BROADCAST_BYTES:
        right = F.broadcast(right)
        left = left.repartition(min(-(-m // block) * -(-k // block), PIECES))  # blocks are few and each makes many: they must not be packed into one task
    pairs = left.join(right, "q").select("r", "c", "q", "data", "other")
    if k <= block:
        return NDFrame(pairs.mapInArrow(whole, "i0 long, i1 long, v double"), (m, n))
    return NDFrame(pairs.mapInArrow(multiply, "r int, c int, data binary").groupBy("r", "c").applyInArrow(add, "i0 long, i1 long, v double"), (m, n))


def multi_dot(*matrices: NDFrame) -> NDFrame:
    """The product of a chain, in the order that the contraction planner finds best."""
    terms = [_LETTERS[k] + _LETTERS[k + 1] for k in range(len(matrices))]
    return einsum(f"{','.join(terms)}->{terms[0][0]}{terms[-1][1]}", *matrices, optimize="optimal" if len(matrices) <= 6 else "greedy")

