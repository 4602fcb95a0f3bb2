"""Arrays put together and taken apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from .. import dtypes
from ..dtypes import promote
from ..frame import NDFrame, broadcast_shapes, normal_axis


def concatenate(arrays: Sequence[NDFrame], axis: int | None = 0) -> NDFrame:
    """A union with the axis' places moved on by the sizes before."""
    arrays = [a.ravel() for a in arrays] if axis is None else list(arrays)
    axis = normal_axis(axis or 0, arrays[0].ndim)
    for a in arrays[1:]:
        if [n for k, n in enumerate(a.shape) if k != axis] != [n for k, n in enumerate(arrays[0].shape) if k != axis]:
            raise ValueError("shapes differ besides the axis")
    kind, at, df = promote(*(a.dtype for a in arrays)), 0, None
    for a in arrays:
        own = a.astype(kind).df.withColumn(f"i{axis}", F.col(f"i{axis}") + at)
        df = own if df is None else df.unionByName(own)
        at += a.shape[axis]
    return NDFrame(df, [at if k == axis else n for k, n in enumerate(arrays[0].shape)], kind)


def stack(arrays: Sequence[NDFrame], axis: int = 0) -> NDFrame:
    return concatenate([a.expand_dims(axis) for a in arrays], axis)


def atleast(x: NDFrame, n: int) -> NDFrame:
    """atleast_1d, atleast_2d and atleast_3d."""
    if x.ndim >= n:
        return x
    shape = {1: lambda s: s or (1,), 2: lambda s: (1, *(s or (1,))), 3: lambda s: (*((1, *s) if len(s) == 1 else s or (1, 1)), 1)}[n](x.shape)
    return x.reshape(list(shape))


def vstack(arrays: Sequence[NDFrame]) -> NDFrame:
    return concatenate([atleast(a, 2) for a in arrays], 0)


def hstack(arrays: Sequence[NDFrame]) -> NDFrame:
    own = [atleast(a, 1) for a in arrays]
    return concatenate(own, 0 if own[0].ndim == 1 else 1)


def dstack(arrays: Sequence[NDFrame]) -> NDFrame:
    return concatenate([atleast(a, 3) for a in arrays], 2)


def column_stack(arrays: Sequence[NDFrame]) -> NDFrame:
    return concatenate([a.expand_dims(1) if a.ndim == 1 else a for a in arrays], 1)


def block(nested) -> NDFrame:
    """Nested lists of arrays: the innermost are joined along the last axis, and so on outwards."""

    def depth(x) -> int:
        return 1 + depth(x[0]) if isinstance(x, list) else 0

    levels = depth(nested)

    def build(x, level: int) -> NDFrame:
        if not isinstance(x, list):
            return x.reshape([1] * (levels - x.ndim) + list(x.shape)) if x.ndim < levels else x
        parts = [build(p, level + 1) for p in x]
        return concatenate(parts, parts[0].ndim - levels + level)

    return build(nested, 0)


def array_split(x: NDFrame, parts: int | Sequence[int], axis: int = 0) -> list[NDFrame]:
    """At the given places, or into parts whose sizes differ by one at most, the larger first."""
    axis = normal_axis(axis, x.ndim)
    n = x.shape[axis]
    if isinstance(parts, int):
        size, more = divmod(n, parts)
        cuts = [k * size + min(k, more) for k in range(parts + 1)]
    else:
        cuts = [0, *parts, n]
    return [x[(*[slice(None)] * axis, slice(a, b))] for a, b in zip(cuts, cuts[1:])]


def split(x: NDFrame, parts: int | Sequence[int], axis: int = 0) -> list[NDFrame]:
    if isinstance(parts, int) and x.shape[axis] % parts:
        raise ValueError("the axis can't be divided evenly")
    return array_split(x, parts, axis)


def unstack(x: NDFrame, axis: int = 0) -> list[NDFrame]:
    axis = normal_axis(axis, x.ndim)
    return [x[(*[slice(None)] * axis, k)] for k in range(x.shape[axis])]


def delete(x: NDFrame, places: Sequence[int], axis: int | None = None) -> NDFrame:
    own, axis = (x.ravel(), 0) if axis is None else (x, normal_axis(axis, x.ndim))
    n = own.shape[axis]
    gone = sorted({p % n for p in places})
    i = F.col(f"i{axis}")
    before = F.size(F.filter(F.array(*map(F.lit, gone)), lambda p: p < i)) if gone else F.lit(0)
    df = own.df.filter(~i.isin(gone)) if gone else own.df
    return NDFrame(df.withColumn(f"i{axis}", i - before), [m - len(gone) if k == axis else m for k, m in enumerate(own.shape)], x.dtype)


def insert(x: NDFrame, places: Sequence[int], values: Sequence, axis: int | None = None) -> NDFrame:
    """One value (or all of a slice) before each place of the array as it was."""
    own, axis = (x.ravel(), 0) if axis is None else (x, normal_axis(axis, x.ndim))
    n = own.shape[axis]
    new = sorted(((p + n if p < 0 else p), k, v) for k, (p, v) in enumerate(zip(places, values)))
    i = F.col(f"i{axis}")
    shift = F.size(F.filter(F.array(*(F.lit(p) for p, _, _ in new)), lambda p: p <= i))
    df = own.df.withColumn(f"i{axis}", i + shift)
    spark = x.spark
    table = F.broadcast(spark.createDataFrame([(p + k, float(v)) for k, (p, _, v) in enumerate(new)], "_p long, _v double"))
    others = [f"i{k}" for k in range(own.ndim) if k != axis]
    rest = own.df.select(*others).distinct() if others else None
    made = (rest.crossJoin(table) if rest is not None else table).withColumn(f"i{axis}", F.col("_p")).withColumn("v", dtypes.cast(F.col("_v"), "float64", x.dtype))
    return NDFrame(df.unionByName(made.select(*df.columns)), [m + len(new) if k == axis else m for k, m in enumerate(own.shape)], x.dtype)


def resize(x: NDFrame, shape: Sequence[int]) -> NDFrame:
    """The values in C order, repeated or cut to fill the new shape."""
    import math

    size = math.prod(shape)
    times = -(-size // x.size)
    flat = x.ravel().tile(times)[:size] if times > 1 or size < x.size else x.ravel()
    return flat.reshape(list(shape))


def pad(x: NDFrame, widths: Sequence[tuple[int, int]], mode: str = "constant", value=0) -> NDFrame:
    """Borders by constant, empty (zeros), edge, reflect, symmetric, wrap, linear_ramp, or maximum, minimum, mean and median of a lane; a constant may be one, a pair for both ends, or a pair for each axis."""
    ends = lambda v: (v, v) if not isinstance(v, (tuple, list)) else tuple(v) if len(v) == 2 else (v[0], v[0])
    nested = isinstance(value, (tuple, list)) and len(value) and isinstance(value[0], (tuple, list))
    if mode == "empty":
        mode, value, nested = "constant", 0, False
    if mode == "constant" and isinstance(value, (tuple, list)):
        each = [ends(value[axis if len(value) > 1 else 0]) if nested else ends(value) for axis in range(x.ndim)]
        for axis, (lo, hi) in enumerate(widths):
            for n, side, v in ((lo, (lo, 0), each[axis][0]), (hi, (0, hi), each[axis][1])):
                if n:
                    x = _padded(x, axis, *side, mode, v)
        return x
    for axis, (lo, hi) in enumerate(widths):
        if lo or hi:
            x = _padded(x, axis, lo, hi, mode, value)
    return x


def _padded(x: NDFrame, axis: int, lo: int, hi: int, mode: str, value) -> NDFrame:
    n, name = x.shape[axis], f"i{axis}"
    shape = [lo + m + hi if k == axis else m for k, m in enumerate(x.shape)]
    others = [f"i{k}" for k in range(x.ndim) if k != axis]
    border = [*range(-lo, 0), *range(n, n + hi)]
    if mode in ("edge", "reflect", "symmetric", "wrap"):
        source = {
            "edge": lambda p: min(max(p, 0), n - 1),
            "wrap": lambda p: p % n,
            "symmetric": lambda p: (q if (q := p % (2 * n)) < n else 2 * n - 1 - q),
            "reflect": lambda p: 0 if n == 1 else (q if (q := p % (2 * n - 2)) < n else 2 * n - 2 - q),
        }[mode]
        table = F.broadcast(x.spark.createDataFrame([(source(p), p + lo) for p in [*border]], f"{name} long, _to long"))
        made = x.df.join(table, name).withColumn(name, F.col("_to")).select(*x.df.columns)
    else:
        table = F.broadcast(x.spark.createDataFrame([(p + lo, float(abs(p) if p < 0 else p - n + 1), p < 0) for p in border], "_to long, _far double, _low boolean"))
        v = F.col("v").cast("double")
        if mode == "constant":
            lanes = x.df.groupBy(*others).agg(F.lit(float(value)).alias("_e")) if others else x.spark.createDataFrame([(float(value),)], "_e double")
            new = F.col("_e")
        elif mode == "linear_ramp":
            lanes = x.df.groupBy(*others).agg(F.max(F.when(F.col(name) == 0, v)).alias("_first"), F.max(F.when(F.col(name) == n - 1, v)).alias("_last"))
            edge, width = F.when(F.col("_low"), F.col("_first")).otherwise(F.col("_last")), F.when(F.col("_low"), F.lit(float(max(lo, 1)))).otherwise(F.lit(float(max(hi, 1))))
            new = edge + (float(value) - edge) * F.col("_far") / width
        else:
            lanes = x.df.groupBy(*others).agg({"maximum": F.max, "minimum": F.min, "mean": F.avg, "median": F.median}[mode](v).alias("_e"))
            new = F.rint("_e") if x.dtype.kind in "iu" else F.col("_e")
        made = lanes.crossJoin(table).withColumn(name, F.col("_to")).withColumn("v", dtypes.cast(new.cast("double"), "float64", x.dtype)).select(*x.df.columns)
    return NDFrame(x.df.withColumn(name, F.col(name) + lo).unionByName(made), shape, x.dtype)


def trim_zeros(x: NDFrame) -> NDFrame:
    """A vector without its leading and trailing zeros."""
    row = x.df.filter("v != 0").agg(F.min("i0").alias("a"), F.max("i0").alias("b")).first()
    return x[0:0] if row["a"] is None else x[row["a"] : row["b"] + 1]


def packbits(x: NDFrame, little: bool = False) -> NDFrame:
    """Eight truth values of a vector to one byte."""
    place = F.col("i0") % 8
    weight = F.call_function("shiftleft", F.lit(1), (place if little else 7 - place).cast("int"))
    df = x.df.groupBy(F.floor(F.col("i0") / 8).alias("i0")).agg(F.sum(F.when(F.col("v") != (F.lit(False) if x.dtype.kind == "b" else 0), weight).otherwise(0)).cast("smallint").alias("v"))
    return NDFrame(df, [-(-x.shape[0] // 8)], "uint8")


def unpackbits(x: NDFrame, little: bool = False) -> NDFrame:
    df = x.df.select(F.col("i0").alias("_b"), "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k"))
    bit = F.call_function("shiftright", F.col("v").cast("int"), F.col("_k") if little else 7 - F.col("_k")).bitwiseAND(F.lit(1))
    return NDFrame(df.select((F.col("_b") * 8 + F.col("_k")).alias("i0"), bit.cast("smallint").alias("v")), [x.shape[0] * 8], "uint8")


def append(x: NDFrame, values: NDFrame, axis: int | None = None) -> NDFrame:
    """``values`` behind ``x``: of both flattened, or along an axis."""
    return concatenate([x.ravel(), values.ravel()], 0) if axis is None else concatenate([x, values], axis)


def broadcast_arrays(*arrays: NDFrame) -> list[NDFrame]:
    shape = broadcast_shapes(*(x.shape for x in arrays))
    return [x.broadcast_to(shape) for x in arrays]


def rollaxis(x: NDFrame, axis: int, start: int = 0) -> NDFrame:
    """Moves an axis before the one that is at ``start``."""
    axis, start = normal_axis(axis, x.ndim), start + x.ndim if start < 0 else start
    return x.moveaxis(axis, start - (axis < start))


def hsplit(x: NDFrame, parts) -> list[NDFrame]:
    return split(x, parts, 1 if x.ndim > 1 else 0)


def vsplit(x: NDFrame, parts) -> list[NDFrame]:
    return split(x, parts, 0)


def dsplit(x: NDFrame, parts) -> list[NDFrame]:
    return split(x, parts, 2)


def fliplr(x: NDFrame) -> NDFrame:
    return x.flip(1)


def flipud(x: NDFrame) -> NDFrame:
    return x.flip(0)
