"""Arrays as DataFrames.

An ``NDFrame`` is a DataFrame with index columns ``i0`` ... ``i{n-1}`` and a
value column ``v``, with its shape and element type kept on the driver.  Every
index has one row.  Operations build DataFrame plans: reshaping is arithmetic
on index columns, broadcasting is a join on the axes that both sides have,
reductions group by the axes that stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dtypes
from .dtypes import DType, dtype, promote, result_type
from .functions import complexes, real
from .storage import numbered

#: Elements up to which an operand is broadcast to the other; shapes are known on the driver.
BROADCAST_ELEMENTS = 100_000
#: Elements of a block in scans over an axis that no other axis divides.
SCAN_BLOCK = 1 << 16


class AxisError(ValueError, IndexError):
    """An axis that the array doesn't have."""


def normal_axis(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise AxisError(f"axis {axis} is out of bounds for an array of {ndim} dimensions")
    return axis % ndim


def normal_axes(axis, ndim: int) -> tuple[int, ...]:
    if axis is None:
        return tuple(range(ndim))
    axes = tuple(normal_axis(a, ndim) for a in ((axis,) if isinstance(axis, int) else axis))
    if len(set(axes)) < len(axes):
        raise ValueError("repeated axis")
    return axes


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    n = max(map(len, shapes), default=0)
    out = []
    for k in range(n):
        sizes = {s[len(s) - n + k] for s in shapes if len(s) - n + k >= 0} - {1}
        if len(sizes) > 1:
            raise ValueError(f"shapes {shapes} can't be broadcast together")
        out.append(sizes.pop() if sizes else 1)
    return tuple(out)


def idx(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


class NDFrame:
    def __init__(self, df: DataFrame, shape: Sequence[int], kind: str | DType = "float64"):
        self.df, self.shape, self.dtype = df.select(*idx(len(shape)), "v"), tuple(int(n) for n in shape), dtype(kind)

    # What the driver knows

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def T(self) -> NDFrame:
        return self.transpose()

    def __len__(self) -> int:
        return self.shape[0]

    def __repr__(self) -> str:
        return f"NDFrame(shape={self.shape}, dtype={self.dtype.name})"

    def to_numpy(self):
        """The whole array on the driver: for small results."""
        import numpy as np

        rows = self.df.collect()
        out = np.zeros(self.shape, self.dtype.name)
        for r in rows:
            out[tuple(r[:-1])] = complex(r["v"]["re"], r["v"]["im"]) if self.dtype.kind == "c" else r["v"]
        return out

    def tolist(self):
        return self.to_numpy().tolist()

    def item(self):
        if self.size != 1:
            raise ValueError("only arrays of size 1 are scalars")
        return self.to_numpy().item()

    def _new(self, df: DataFrame, shape: Sequence[int], kind=None) -> NDFrame:
        return NDFrame(df, shape, kind or self.dtype)

    def _moved(self, columns: list[Column], shape: Sequence[int], where: Column | None = None) -> NDFrame:
        """New index columns from the old ones."""
        df = self.df if where is None else self.df.filter(where)
        return self._new(df.select(*(c.cast("long").alias(f"i{k}") for k, c in enumerate(columns)), "v"), shape)

    def _i(self, k: int) -> Column:
        return F.col(f"i{k}")

    def flat_index(self) -> Column:
        out = F.lit(0).cast("long")
        for k, n in enumerate(self.shape):
            out = out * F.lit(n) + self._i(k)
        return out

    # Element-wise

    def astype(self, kind, casting: str = "unsafe") -> NDFrame:
        if not dtypes.can_cast(self.dtype, kind, casting):
            raise TypeError(f"can't cast {self.dtype.name} to {dtype(kind).name} by the rule {casting!r}")
        return self._new(self.df.withColumn("v", dtypes.cast(F.col("v"), self.dtype, kind)), self.shape, kind)

    def map(self, f: Callable[[Column], Column], kind=None) -> NDFrame:
        return self._new(self.df.withColumn("v", f(F.col("v"))), self.shape, kind)

    def broadcast_to(self, shape: Sequence[int]) -> NDFrame:
        """Repeats axes of size 1 and adds leading ones; the copies are generated next to each row."""
        if broadcast_shapes(self.shape, shape) != tuple(shape):
            raise ValueError(f"{self.shape} can't be broadcast to {tuple(shape)}")
        lead, df, columns = len(shape) - self.ndim, self.df, []
        for k, n in enumerate(shape):
            own = k - lead
            if own >= 0 and self.shape[own] == n:
                columns.append(self._i(own))
            else:
                df = df.withColumn(f"_b{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))) if n else df.limit(0).withColumn(f"_b{k}", F.lit(0))
                columns.append(F.col(f"_b{k}"))
        return self._new(df.select(*(c.alias(f"i{k}") for k, c in enumerate(columns)), "v"), shape)

    def combine(self, other: NDFrame, f: Callable[[Column, Column], Column], kind) -> NDFrame:
        """Element-wise ``f`` of two arrays that are broadcast together."""
        shape = broadcast_shapes(self.shape, other.shape)
        if self.df is other.df and self.shape == other.shape:
            return self._new(self.df.withColumn("v", f(F.col("v"), F.col("v"))), shape, kind)

        def side(x: NDFrame, name: str) -> tuple[DataFrame, set[int]]:
            lead = len(shape) - x.ndim
            axes = [k for k in range(len(shape)) if k >= lead and (x.shape[k - lead] > 1 or shape[k] != x.shape[k - lead] != 1)]
            df = x.df.select(*(F.col(f"i{k - lead}").alias(f"{name}{k}") for k in axes), F.col("v").alias(name))
            return (F.broadcast(df) if x.size <= BROADCAST_ELEMENTS else df), set(axes)

        (a, own), (b, others) = side(self, "a"), side(other, "b")
        shared = own & others
        on = [F.col(f"a{k}") == F.col(f"b{k}") for k in sorted(shared)]
        if on:
            both = a.join(b, on)
        elif min(self.size, other.size) <= BROADCAST_ELEMENTS:
            both = a.crossJoin(b)  # the smaller side's size is known and bounded
        else:
            raise ValueError("an outer product of two large arrays isn't materialised")
        columns = [F.col(f"a{k}" if k in own else f"b{k}") if k in own | others else F.lit(0).cast("long") for k in range(len(shape))]
        return self._new(both.select(*(c.alias(f"i{k}") for k, c in enumerate(columns)), f(F.col("a"), F.col("b")).alias("v")), shape, kind)

    def _operand(self, x) -> NDFrame | None:
        return x if isinstance(x, NDFrame) else None

    def binary(self, x, name: str, swap: bool = False) -> NDFrame:
        other = self._operand(x)
        kind = result_type(self.dtype, other.dtype if other is not None else x)
        out, f = operation(name, kind)
        work = kind if name != "divide" or kind.kind in "fc" else dtype("float64")

        def g(a: Column, b: Column) -> Column:
            return f(b, a) if swap else f(a, b)

        left = self.astype(work)
        if other is None:
            constant = dtypes.cast(F.lit(x), "bool" if isinstance(x, bool) else "int64" if isinstance(x, int) else "float64", work) if not isinstance(x, complex) else complexes.literal(x)
            return left.map(lambda v: g(v, constant), out)
        return left.combine(left if other is self else other.astype(work), g, out)

    def __add__(self, x):
        return self.binary(x, "add")

    def __radd__(self, x):
        return self.binary(x, "add", True)

    def __sub__(self, x):
        return self.binary(x, "subtract")

    def __rsub__(self, x):
        return self.binary(x, "subtract", True)

    def __mul__(self, x):
        return self.binary(x, "multiply")

    def __rmul__(self, x):
        return self.binary(x, "multiply", True)

    def __truediv__(self, x):
        return self.binary(x, "divide")

    def __rtruediv__(self, x):
        return self.binary(x, "divide", True)

    def __floordiv__(self, x):
        return self.binary(x, "floor_divide")

    def __rfloordiv__(self, x):
        return self.binary(x, "floor_divide", True)

    def __mod__(self, x):
        return self.binary(x, "remainder")

    def __rmod__(self, x):
        return self.binary(x, "remainder", True)

    def __pow__(self, x):
        if self.dtype.kind in "iu" and isinstance(x, int) and not isinstance(x, bool):
            return self.map(lambda v: real.int_power(v, x, self.dtype))
        return self.binary(x, "power")

    def __rpow__(self, x):
        return self.binary(x, "power", True)

    def __and__(self, x):
        return self.binary(x, "bitwise_and")

    def __or__(self, x):
        return self.binary(x, "bitwise_or")

    def __xor__(self, x):
        return self.binary(x, "bitwise_xor")

    def __neg__(self):
        if self.dtype.kind == "b":
            raise TypeError("booleans have no negative")
        return self.binary(0, "subtract", True) if self.dtype.kind in "iu" else self.map(complexes.negative if self.dtype.kind == "c" else lambda v: -v)

    def __pos__(self):
        return self

    def __abs__(self):
        if self.dtype.kind == "c":
            return self.map(complexes.absolute, "float64" if self.dtype.bits == 128 else "float32")
        return self.map(F.abs)

    def __invert__(self):
        return self.map(lambda v: ~v if self.dtype.kind == "b" else F.bitwise_not(v))

    def __eq__(self, x):
        return self.binary(x, "equal")

    def __ne__(self, x):
        return self.binary(x, "not_equal")

    def __lt__(self, x):
        return self.binary(x, "less")

    def __le__(self, x):
        return self.binary(x, "less_equal")

    def __gt__(self, x):
        return self.binary(x, "greater")

    def __ge__(self, x):
        return self.binary(x, "greater_equal")

    __hash__ = None

    # Shape

    def reshape(self, *shape) -> NDFrame:
        shape = list(shape[0] if len(shape) == 1 and not isinstance(shape[0], int) else shape)
        if -1 in shape:
            rest = -math.prod(shape)
            shape[shape.index(-1)] = self.size // rest if rest else 0
        if math.prod(shape) != self.size:
            raise ValueError(f"an array of size {self.size} has no shape {tuple(shape)}")
        return self._moved(unravel(self.flat_index(), shape), shape)

    def ravel(self) -> NDFrame:
        return self.reshape(-1)

    flatten = ravel

    def transpose(self, *axes) -> NDFrame:
        axes = axes[0] if len(axes) == 1 and not isinstance(axes[0], int) else axes
        order = normal_axes(tuple(axes), self.ndim) if axes else tuple(reversed(range(self.ndim)))
        return self._moved([self._i(k) for k in order], [self.shape[k] for k in order])

    def swapaxes(self, a: int, b: int) -> NDFrame:
        order = list(range(self.ndim))
        a, b = normal_axis(a, self.ndim), normal_axis(b, self.ndim)
        order[a], order[b] = b, a
        return self.transpose(order)

    def moveaxis(self, source, to) -> NDFrame:
        source, to = normal_axes(source, self.ndim), normal_axes(to, self.ndim)
        order = [k for k in range(self.ndim) if k not in source]
        for t, s in sorted(zip(to, source)):
            order.insert(t, s)
        return self.transpose(order)

    def squeeze(self, axis=None) -> NDFrame:
        gone = [k for k, n in enumerate(self.shape) if n == 1] if axis is None else normal_axes(axis, self.ndim)
        if any(self.shape[k] != 1 for k in gone):
            raise ValueError("only axes of size 1 can be squeezed")
        kept = [k for k in range(self.ndim) if k not in gone]
        return self._moved([self._i(k) for k in kept], [self.shape[k] for k in kept])

    def expand_dims(self, axis) -> NDFrame:
        new = normal_axes(axis, self.ndim + (1 if isinstance(axis, int) else len(axis)))
        rest = iter(range(self.ndim))
        plan = [None if k in new else next(rest) for k in range(self.ndim + len(new))]
        return self._moved([F.lit(0) if k is None else self._i(k) for k in plan], [1 if k is None else self.shape[k] for k in plan])

    def flip(self, axis=None) -> NDFrame:
        axes = normal_axes(axis, self.ndim)
        return self._moved([F.lit(n - 1) - self._i(k) if k in axes else self._i(k) for k, n in enumerate(self.shape)], self.shape)

    def roll(self, shift, axis=None) -> NDFrame:
        if axis is None:
            return self.ravel().roll(shift, 0).reshape(self.shape)
        shifts = dict(zip(normal_axes(axis, self.ndim), [shift] if isinstance(shift, int) else shift))
        return self._moved([F.pmod(self._i(k) + F.lit(shifts[k]), F.lit(max(n, 1))) if k in shifts else self._i(k) for k, n in enumerate(self.shape)], self.shape)

    def rot90(self, k: int = 1, axes: tuple[int, int] = (0, 1)) -> NDFrame:
        a, b = normal_axes(axes, self.ndim)
        return [lambda: self, lambda: self.swapaxes(a, b).flip(a), lambda: self.flip((a, b)), lambda: self.flip(a).swapaxes(a, b)][k % 4]()

    def repeat(self, times: int, axis: int | None = None) -> NDFrame:
        if axis is None:
            return self.ravel().repeat(times, 0)
        axis = normal_axis(axis, self.ndim)
        df = self.df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        shape = [n * times if k == axis else n for k, n in enumerate(self.shape)]
        return NDFrame(df.withColumn(f"i{axis}", self._i(axis) * times + F.col("_r")), shape, self.dtype)

    def tile(self, reps) -> NDFrame:
        reps = [reps] if isinstance(reps, int) else list(reps)
        own = self.reshape([1] * (len(reps) - self.ndim) + list(self.shape)) if len(reps) > self.ndim else self
        reps = [1] * (own.ndim - len(reps)) + reps
        df = own.df
        for k, r in enumerate(reps):
            if r != 1:
                df = df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(r - 1)))).withColumn(f"i{k}", F.col(f"i{k}") + F.col("_r") * own.shape[k]).drop("_r")
        return NDFrame(df, [n * r for n, r in zip(own.shape, reps)], self.dtype)

    def diagonal(self, k: int = 0) -> NDFrame:
        """The k-th diagonal of the last two axes, which becomes the last axis."""
        *lead, m, n = self.shape
        a, b = self._i(self.ndim - 2), self._i(self.ndim - 1)
        size = max(0, min(m + min(k, 0), n - max(k, 0)))
        return self._moved([*(self._i(j) for j in range(self.ndim - 2)), F.least(a, b)], [*lead, size], b - a == k)

    def triangle(self, lower: bool, k: int = 0) -> NDFrame:
        """tril or triu: zero beyond the k-th diagonal."""
        a, b = self._i(self.ndim - 2), self._i(self.ndim - 1)
        keep = (b - a <= k) if lower else (b - a >= k)
        return self._new(self.df.withColumn("v", F.when(keep, F.col("v")).otherwise(dtypes.cast(F.lit(0), "int64", self.dtype))), self.shape)

    # Selection

    def __getitem__(self, key) -> NDFrame:
        """Slices, whole numbers, None, Ellipsis, index arrays or lists, or a boolean array of the leading axes."""
        if isinstance(key, NDFrame) and key.dtype.kind == "b":
            return self._masked(key)
        key = key if isinstance(key, tuple) else (key,)
        if any(k is Ellipsis for k in key):
            at = next(j for j, k in enumerate(key) if k is Ellipsis)
            missing = self.ndim - sum(k is not None and k is not Ellipsis for k in key)
            key = (*key[:at], *[slice(None)] * missing, *key[at + 1 :])
        if sum(k is not None for k in key) > self.ndim:
            raise IndexError("too many indices")
        arrays = [k for k in key if isinstance(k, NDFrame) or getattr(k, "ndim", 1) != 1 or (isinstance(k, list) and k and isinstance(k[0], (list, tuple)))]
        lists = [k for k in key if k is not None and not isinstance(k, (slice, int))]
        if arrays or len(lists) > 1 or (lists and any(isinstance(k, int) for k in key)):
            from .operators.indexing import advanced

            return advanced(self, (*key, *[slice(None)] * (self.ndim - sum(k is not None for k in key))))
        out, columns, shape, where, axis, places = self, [], [], F.lit(True), 0, None
        for k in (*key, *[slice(None)] * (self.ndim - sum(k is not None for k in key))):
            if k is None:
                columns.append(F.lit(0))
                shape.append(1)
                continue
            n, i = self.shape[axis], self._i(axis)
            if isinstance(k, slice):
                start, stop, step = k.indices(n)
                size = len(range(start, stop, step))
                if (start, step, size) != (0, 1, n):
                    where = where & F.expr(f"i{axis}").between(min(start, start + (size - 1) * step), max(start, start + (size - 1) * step)) & ((i - start) % step == 0) if size else F.lit(False)
                columns.append(F.floor((i - start) / step) if step != 1 else i - start)
                shape.append(size)
            elif isinstance(k, int):
                if not -n <= k < n:
                    raise IndexError(f"index {k} is out of bounds for axis {axis} of size {n}")
                where = where & (i == k % n)
            else:
                places = (axis, [p % n for p in k])
                if any(not -n <= p < n for p in k):
                    raise IndexError("a place is out of bounds")
                columns.append(F.col("_to"))
                shape.append(len(k))
            axis += 1
        if places is not None:
            table = self.spark.createDataFrame([(p, to) for to, p in enumerate(places[1])], f"i{places[0]} long, _to long")
            out = NDFrame.__new__(NDFrame)
            out.df, out.shape, out.dtype = self.df.join(F.broadcast(table), f"i{places[0]}"), self.shape, self.dtype
        return NDFrame._moved(out, columns, shape, where)

    def _masked(self, mask: NDFrame) -> NDFrame:
        """Values where a mask of the leading axes is true, in C order along one axis."""
        if mask.shape != self.shape[: mask.ndim]:
            raise IndexError("the mask's shape isn't that of the leading axes")
        on = idx(mask.ndim)
        chosen = mask.df.filter("v").drop("v")
        rest = list(self.shape[mask.ndim :])
        places = numbered(chosen, on)
        n = places.count()
        df = self.df.join(F.broadcast(places) if n <= BROADCAST_ELEMENTS else places, on)
        columns = [F.col("pos"), *(self._i(k) for k in range(mask.ndim, self.ndim))]
        return self._new(df.select(*(c.alias(f"i{k}") for k, c in enumerate(columns)), "v"), [n, *rest])

    def take(self, places: Sequence[int], axis: int | None = None, mode: str = "raise") -> NDFrame:
        own = self.ravel() if axis is None else self
        axis = 0 if axis is None else normal_axis(axis, self.ndim)
        n = own.shape[axis]
        places = [p % n for p in places] if mode == "wrap" else [min(max(p, 0), n - 1) for p in places] if mode == "clip" else list(places)
        return own[(*[slice(None)] * axis, places)]

    def put(self, updates: dict) -> NDFrame:
        """A copy with values at flat places replaced; of repeated places the last counts."""
        table = F.broadcast(self.spark.createDataFrame([(p % self.size, v) for p, v in updates.items()], "_p long, _n double"))
        new = dtypes.cast(F.col("_n"), "float64", self.dtype)
        df = self.df.withColumn("_p", self.flat_index()).join(table, "_p", "left")
        return self._new(df.withColumn("v", F.when(F.col("_n").isNotNull(), new).otherwise(F.col("v"))), self.shape)

    # Reductions and scans

    def reduce(self, f: Callable[[Column], Column], kind=None, axis=None, keepdims: bool = False) -> NDFrame:
        """``f`` is an aggregate of the value column; it may also use the index columns."""
        axes = normal_axes(axis, self.ndim)
        kept = [k for k in range(self.ndim) if k not in axes]
        df = self.df.groupBy(*(f"i{k}" for k in kept)).agg(f(F.col("v")).alias("v"))
        columns = [F.lit(0) if k in axes else self._i(k) for k in range(self.ndim)] if keepdims else [self._i(k) for k in kept]
        shape = [1 if k in axes else n for k, n in enumerate(self.shape)] if keepdims else [self.shape[k] for k in kept]
        return NDFrame(df.select(*(c.cast("long").alias(f"i{k}") for k, c in enumerate(columns)), "v"), shape, kind or self.dtype)

    def scan(self, f: Callable[[Column], Column], merge: Callable[[Column, Column], Column], axis: int, kind=None) -> NDFrame:
        """A running aggregate along an axis.

        The axis is cut into blocks: each is scanned on its own and then merged
        with the scan of the blocks before it, which are cut into blocks
        themselves if they are many.
        """
        axis = normal_axis(axis, self.ndim)
        others = [f"i{k}" for k in range(self.ndim) if k != axis]
        if self.shape[axis] <= SCAN_BLOCK:
            w = Window.partitionBy(*others, F.floor(self._i(axis) / SCAN_BLOCK)).orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
            return self._new(self.df.withColumn("v", f(F.col("v")).over(w)), self.shape, kind)
        df = self.df.withColumn("_block", F.floor(self._i(axis) / SCAN_BLOCK))
        inner = Window.partitionBy(*others, "_block").orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
        blocks = df.groupBy(*others, F.col("_block").alias(f"i{axis}")).agg(f(F.col("v")).alias("v"))
        shape = [-(-n // SCAN_BLOCK) if k == axis else n for k, n in enumerate(self.shape)]
        running = NDFrame(blocks, shape, kind or self.dtype).scan(f, merge, axis, kind)
        totals = running.df.select(*others, (self._i(axis) + 1).alias("_block"), F.col("v").alias("_before"))
        both = df.withColumn("_own", f(F.col("v")).over(inner)).join(totals, [*others, "_block"], "left")
        return self._new(both.withColumn("v", F.when(F.col("_before").isNull(), F.col("_own")).otherwise(merge(F.col("_before"), F.col("_own")))), self.shape, kind)


def unravel(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Index columns of a flat C-order position."""
    out, step = [], 1
    for n in reversed(shape):
        out.append(F.floor(flat / F.lit(step)) % F.lit(n) if step > 1 else flat % F.lit(max(n, 1)))
        step *= max(n, 1)
    return [c.cast("long") for c in reversed(out)]


def operation(name: str, kind: DType) -> tuple[DType, Callable[[Column, Column], Column]]:
    """The result type and the Column function of a binary operation on operands of ``kind``."""
    if name in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal"):
        if kind.kind == "c":
            return dtype("bool"), getattr(complexes, name)
        return dtype("bool"), getattr(real, name)
    if name.startswith("bitwise_"):
        if kind.kind not in "biu":
            raise TypeError(f"{name} needs whole numbers")
        method = {"bitwise_and": "bitwiseAND", "bitwise_or": "bitwiseOR", "bitwise_xor": "bitwiseXOR"}[name]
        if kind.kind == "b":
            return kind, {"bitwise_and": lambda a, b: a & b, "bitwise_or": lambda a, b: a | b, "bitwise_xor": lambda a, b: a != b}[name]
        return kind, lambda a, b: getattr(a, method)(b)
    if kind.kind == "c":
        return kind, getattr(complexes, name)
    if kind.kind == "b":
        if name == "subtract":
            raise TypeError("booleans can't be subtracted")
        if name in ("add", "multiply"):
            return kind, (lambda a, b: a | b) if name == "add" else (lambda a, b: a & b)
        kind = dtype("int8")
    if kind.kind == "f" or name in ("divide", "power"):
        out = kind if kind.kind == "f" else dtype("float64")
        plain = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b}
        f = plain.get(name) or getattr(real, name)
        return out, lambda a, b: f(a, b).cast(out.spark)
    if name in ("floor_divide", "add", "subtract", "multiply"):
        return kind, lambda a, b: getattr(real, f"int_{name}")(a, b, kind)
    return kind, getattr(real, f"int_{name}", None) or getattr(real, name)


__all__ = ["AxisError", "NDFrame", "broadcast_shapes", "idx", "normal_axes", "normal_axis", "operation", "promote", "unravel"]
