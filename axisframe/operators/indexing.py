"""Index arrays: gathers and scatters as joins on places, and the places of masks, diagonals and triangles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dtypes
from ..frame import BROADCAST_ELEMENTS, NDFrame, broadcast_shapes, idx, normal_axis, unravel
from ..storage import numbered
from . import creation


def _joined(df: DataFrame, table: DataFrame, size: int, on: list, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(table) if size <= BROADCAST_ELEMENTS else table, on, how)


def _at(i: Column, n: int) -> Column:
    """A place counted from either end; one that isn't there fails the job."""
    return F.when((i >= -n) & (i < n), F.pmod(i, F.lit(max(n, 1)))).otherwise(F.raise_error(F.lit(f"a place is out of bounds for an axis of size {n}")))


def as_array(x: NDFrame, values) -> NDFrame:
    """``values`` as an array in the session of ``x``; NDFrames as they are."""
    return values if isinstance(values, NDFrame) else creation.array(x.spark, values)


# Gathers


def advanced(x: NDFrame, key: tuple) -> NDFrame:
    """Selection by several index arrays, lists or whole numbers, which are broadcast together; slices and None select as ever.

    The axes of the index arrays stand where the first of them stood if they
    are neighbours, else first.
    """
    places, basic, axis = [], [], 0
    for k in key:
        if isinstance(k, (slice, type(None))):
            basic.append(k)
        else:
            places.append((len(basic), axis, as_array(x, k)))
            basic.append(slice(None))
        axis += k is not None
    own = x[tuple(basic)]
    shape = broadcast_shapes(*(p.shape for _, _, p in places))
    table = None
    for n, (at, _, p) in enumerate(places):
        wide = p.broadcast_to(shape).df.select(*(F.col(c).alias(f"s{c}") for c in idx(len(shape))), _at(F.col("v"), own.shape[at]).cast("long").alias(f"p{n}"))
        table = wide if table is None else table.join(wide, [f"s{c}" for c in idx(len(shape))]) if shape else table.crossJoin(wide)
    both = _joined(own.df, table, math.prod(shape), [F.col(f"i{at}") == F.col(f"p{n}") for n, (at, _, _) in enumerate(places)])
    chosen = [at for at, _, _ in places]
    rest = [k for k in range(own.ndim) if k not in chosen]
    together = chosen == list(range(chosen[0], chosen[0] + len(chosen)))
    before = [k for k in rest if k < chosen[0]] if together else []
    after = [k for k in rest if k not in before]
    columns = [*(f"i{k}" for k in before), *(f"s{c}" for c in idx(len(shape))), *(f"i{k}" for k in after)]
    out = both.select(*(F.col(c).alias(f"i{j}") for j, c in enumerate(columns)), "v")
    return NDFrame(out, [*(own.shape[k] for k in before), *shape, *(own.shape[k] for k in after)], x.dtype)


def vindex(x: NDFrame, *places) -> NDFrame:
    """The elements at places given by one index array an axis."""
    return advanced(x, (*places, *[slice(None)] * (x.ndim - len(places))))


def ix_(*places: Sequence[int]) -> tuple:
    """Index arrays of an open mesh, each along its own axis."""
    import numpy as np

    return tuple(np.asarray(p, np.int64).reshape([len(p) if j == k else 1 for j in range(len(places))]) for k, p in enumerate(places))


def oindex(x: NDFrame, *places: Sequence[int]) -> NDFrame:
    """The elements in all combinations of places along each axis."""
    return vindex(x, *ix_(*places))


def take_along_axis(x: NDFrame, places: NDFrame, axis: int) -> NDFrame:
    """out[..., k, ...] = x[..., places[..., k, ...], ...] along one axis."""
    axis = normal_axis(axis, x.ndim)
    others = [f"i{k}" for k in range(x.ndim) if k != axis]
    asked = places.df.select(*others, F.col(f"i{axis}").alias("_k"), _at(F.col("v"), x.shape[axis]).cast("long").alias(f"i{axis}"))
    out = _joined(x.df, asked, places.size, [*others, f"i{axis}"])
    return NDFrame(out.withColumn(f"i{axis}", F.col("_k")), places.shape, x.dtype)


def compress(mask: Sequence[bool], x: NDFrame, axis: int | None = None) -> NDFrame:
    own = x.ravel() if axis is None else x
    axis = 0 if axis is None else normal_axis(axis, x.ndim)
    return own[(*[slice(None)] * axis, [k for k, m in enumerate(mask) if m])]


def extract(mask: NDFrame, x: NDFrame) -> NDFrame:
    return x.ravel()[mask.astype("bool").ravel()]


# Scatters: copies with some elements replaced


def _replaced(x: NDFrame, updates: DataFrame, size: int) -> NDFrame:
    """``updates``: (_p flat place, _n new value), at most one for each place."""
    both = _joined(x.df.withColumn("_p", x.flat_index()), updates.select("_p", F.struct("_n").alias("_u")), size, ["_p"], "left")
    return NDFrame(both.withColumn("v", F.when(F.col("_u").isNotNull(), F.col("_u._n")).otherwise(F.col("v"))), x.shape, x.dtype)


def _last(updates: DataFrame, order: Column) -> DataFrame:
    """Of the updates of one place the last counts."""
    return updates.groupBy("_p").agg(F.max(F.struct(order.alias("o"), "_n"))["_n"].alias("_n"))


def assign(x: NDFrame, key, value) -> NDFrame:
    """A copy of ``x`` in which what ``key`` selects is ``value``, broadcast to the selection; of repeated places the last counts."""
    places = NDFrame(x.df.withColumn("v", x.flat_index()), x.shape, "int64")[key]
    if not isinstance(value, NDFrame) and not isinstance(value, (list, tuple)) and not hasattr(value, "__array__"):
        updates = places.df.select(F.col("v").alias("_p"), _cast(F.lit(value), x).alias("_n")).distinct()
        return _replaced(x, updates, places.size)
    new = as_array(x, value).astype(x.dtype).broadcast_to(places.shape)
    on = idx(places.ndim)
    both = places.df.withColumnRenamed("v", "_p").join(new.df.withColumnRenamed("v", "_n"), on) if on else places.df.withColumnRenamed("v", "_p").crossJoin(new.df.withColumnRenamed("v", "_n"))
    return _replaced(x, _last(both, places.flat_index() if on else F.lit(0)), places.size)


def _cast(value: Column, x: NDFrame) -> Column:
    return value.cast(x.dtype.spark)


def put_along_axis(x: NDFrame, places: NDFrame, values, axis: int) -> NDFrame:
    """A copy with x[..., places[..., k, ...], ...] = values[..., k, ...]; of repeated places the last counts."""
    axis = normal_axis(axis, x.ndim)
    new = (values if isinstance(values, NDFrame) else creation.full_like(places, values, x.dtype)).astype(x.dtype).broadcast_to(places.shape)
    both = places.df.withColumn("_k", _at(F.col("v"), x.shape[axis])).join(new.df.withColumnRenamed("v", "_n"), idx(x.ndim))
    flat = NDFrame(both.withColumn("v", F.lit(0)), x.shape, "int64")
    target = F.lit(0).cast("long")
    for k, n in enumerate(x.shape):
        target = target * F.lit(n) + (F.col("_k") if k == axis else flat._i(k))
    return _replaced(x, _last(both.withColumn("_p", target), F.col(f"i{axis}")), places.size)


def copyto(x: NDFrame, source, where: NDFrame | None = None) -> NDFrame:
    """A copy of ``x`` with the elements of ``source`` where a mask is true."""
    source = (source if isinstance(source, NDFrame) else creation.full_like(x, source)).astype(x.dtype).broadcast_to(x.shape)
    if where is None:
        return source
    new = source.combine(where.broadcast_to(x.shape), lambda a, m: F.struct(m.alias("m"), a.alias("n")), x.dtype)
    return x.combine(new, lambda a, s: F.when(s["m"], s["n"]).otherwise(a), x.dtype)


def putmask(x: NDFrame, mask: NDFrame, values: Sequence) -> NDFrame:
    """A copy in which element k of those where the mask is true is values[k % len(values)], k counted over all elements."""
    return _repeated(x, mask, values, lambda chosen: chosen.withColumn("_k", F.col("_p")))


def place(x: NDFrame, mask: NDFrame, values: Sequence) -> NDFrame:
    """As putmask, but k counts only the elements where the mask is true."""
    return _repeated(x, mask, values, lambda chosen: numbered(chosen, [F.col("_p")], "_k"))


def _repeated(x: NDFrame, mask: NDFrame, values: Sequence, count: Callable[[DataFrame], DataFrame]) -> NDFrame:
    chosen = count(mask.df.filter("v").select(mask.flat_index().alias("_p")))
    value = F.get(F.array(*(_cast(F.lit(v), x) for v in values)), (F.col("_k") % len(values)).cast("int"))
    return _replaced(x, chosen.select("_p", value.alias("_n")), x.size)


def fill_diagonal(x: NDFrame, value) -> NDFrame:
    """A copy with a value on the main diagonal of all axes."""
    same = F.lit(True)
    for k in range(1, x.ndim):
        same = same & (F.col("i0") == x._i(k))
    return NDFrame(x.df.withColumn("v", F.when(same, _cast(F.lit(value), x)).otherwise(F.col("v"))), x.shape, x.dtype)


def fill(x: NDFrame, value) -> NDFrame:
    return creation.full_like(x, value)


def piecewise(x: NDFrame, pieces: Sequence[tuple[Callable[[Column], Column], Callable[[Column], Column]]], otherwise: Callable[[Column], Column] = lambda v: F.lit(0.0), kind=None) -> NDFrame:
    """Of (condition, function) pairs the last whose condition holds gives an element's value."""

    def value(v: Column) -> Column:
        out = None
        for condition, f in reversed(pieces):
            out = F.when(condition(v), f(v)) if out is None else out.when(condition(v), f(v))
        return (out.otherwise(otherwise(v)) if out is not None else otherwise(v)).cast(dtypes.dtype(kind or x.dtype).spark)

    return x.map(value, kind)


# Places


def _nonzero(x: NDFrame) -> Column:
    v = F.col("v")
    return (v["re"] != 0) | (v["im"] != 0) if x.dtype.kind == "c" else v if x.dtype.kind == "b" else v != 0


def argwhere(x: NDFrame) -> NDFrame:
    """One row of places for each element that isn't zero, in C order."""
    on = idx(x.ndim)
    found = numbered(x.df.filter(_nonzero(x)).select(*on), on)
    rows = found.select("pos", F.posexplode(F.array(*on)).alias("k", "v"))
    return NDFrame(rows.select(F.col("pos").alias("i0"), F.col("k").cast("long").alias("i1"), "v"), [found.count(), x.ndim], "int64")


def flatnonzero(x: NDFrame) -> NDFrame:
    """The flat places of the elements that aren't zero."""
    found = numbered(x.df.filter(_nonzero(x)).select(x.flat_index().alias("v")), ["v"])
    return NDFrame(found.select(F.col("pos").alias("i0"), "v"), [found.count()], "int64")


def unravel_index(flat: NDFrame, shape: Sequence[int]) -> list[NDFrame]:
    """The places along each axis of a shape that flat places stand for."""
    size = math.prod(shape)
    return [flat.map(lambda v, k=k: unravel(_at(v, size), shape)[k], "int64") for k in range(len(shape))]


def ravel_multi_index(places: Sequence[NDFrame], shape: Sequence[int], mode: str = "raise") -> NDFrame:
    """The flat places that places along each axis stand for."""

    def bounded(v: Column, n: int) -> Column:
        if mode == "wrap":
            return F.pmod(v, F.lit(n))
        if mode == "clip":
            return F.greatest(F.least(v, F.lit(n - 1)), F.lit(0))
        return F.when((v >= 0) & (v < n), v).otherwise(F.raise_error(F.lit(f"a place is out of bounds for an axis of size {n}")))

    out = places[0].map(lambda v: bounded(v, shape[0]), "int64")
    for p, n in zip(places[1:], shape[1:]):
        out = out.combine(p, lambda a, b, n=n: a * n + bounded(b, n), "int64")
    return out


def mask_indices(x: NDFrame) -> list[NDFrame]:
    """The places along each axis of the elements of ``x`` that aren't zero, in C order."""
    on = idx(x.ndim)
    found = numbered(x.df.filter(_nonzero(x)).select(*on), on)
    n = found.count()
    return [NDFrame(found.select(F.col("pos").alias("i0"), F.col(c).alias("v")), [n], "int64") for c in on]


def tril_indices(spark, n: int, k: int = 0, m: int | None = None) -> list[NDFrame]:
    return mask_indices(creation.tri(spark, n, m, k))


def triu_indices(spark, n: int, k: int = 0, m: int | None = None) -> list[NDFrame]:
    return mask_indices(creation.tri(spark, n, m, k - 1).map(lambda v: 1 - v))


def tril_indices_from(x: NDFrame, k: int = 0) -> list[NDFrame]:
    return tril_indices(x.spark, x.shape[-2], k, x.shape[-1])


def triu_indices_from(x: NDFrame, k: int = 0) -> list[NDFrame]:
    return triu_indices(x.spark, x.shape[-2], k, x.shape[-1])


def diag_indices(spark, n: int, ndim: int = 2) -> list[NDFrame]:
    return [creation.arange(spark, n)] * ndim


def diag_indices_from(x: NDFrame) -> list[NDFrame]:
    if x.ndim < 2 or len(set(x.shape)) > 1:
        raise ValueError("an array of at least two equal axes is needed")
    return diag_indices(x.spark, x.shape[0], x.ndim)


def ndindex(spark, shape: Sequence[int]) -> DataFrame:
    """The places of a shape: pos, i0, i1, ..."""
    at = unravel(F.col("id"), shape)
    return spark.range(math.prod(shape)).select(F.col("id").alias("pos"), *(c.alias(f"i{k}") for k, c in enumerate(at)))


def ndenumerate(x: NDFrame) -> DataFrame:
    """Places and values: pos, i0, i1, ..., v."""
    return x.df.select(x.flat_index().alias("pos"), *idx(x.ndim), "v")
