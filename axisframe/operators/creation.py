"""Arrays from nothing: every one is a range and an expression, generated by the tasks that need it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import dtypes
from ..dtypes import dtype
from ..frame import NDFrame, idx, unravel
from ..functions import real as R


def grid(spark: SparkSession, shape: Sequence[int], value: Column, kind="float64") -> NDFrame:
    """An array whose values are an expression of the index columns."""
    df = spark.range(math.prod(shape)).select(*(c.alias(f"i{k}") for k, c in enumerate(unravel(F.col("id"), shape))))
    return NDFrame(df.withColumn("v", value.cast(dtype(kind).spark)), shape, kind)


def full(spark: SparkSession, shape: Sequence[int], fill, kind="float64") -> NDFrame:
    return grid(spark, shape, F.lit(fill), kind)


def zeros(spark: SparkSession, shape: Sequence[int], kind="float64") -> NDFrame:
    return full(spark, shape, 0, kind)


def ones(spark: SparkSession, shape: Sequence[int], kind="float64") -> NDFrame:
    return full(spark, shape, 1, kind)


def empty(spark: SparkSession, shape: Sequence[int], kind="float64") -> NDFrame:
    """As zeros: there is no memory to leave as it is."""
    return zeros(spark, shape, kind)


def identity(spark: SparkSession, n: int, kind="float64") -> NDFrame:
    return eye(spark, n, kind=kind)


def zeros_like(x: NDFrame, kind=None) -> NDFrame:
    return full_like(x, 0, kind)


def ones_like(x: NDFrame, kind=None) -> NDFrame:
    return full_like(x, 1, kind)


empty_like = zeros_like


def full_like(x: NDFrame, fill, kind=None) -> NDFrame:
    return x.map(lambda v: F.lit(fill).cast(dtype(kind or x.dtype).spark), kind)


def array(spark: SparkSession, values, kind=None) -> NDFrame:
    """From nested lists or a numpy array on the driver."""
    import numpy as np

    a = np.asarray(values)
    kind = dtype(kind or a.dtype.name)
    rows = [(*map(int, at), {"re": float(v.real), "im": float(v.imag)} if kind.kind == "c" else v.item()) for at, v in np.ndenumerate(a.astype(kind.name))]
    schema = ", ".join([*(f"{i} long" for i in idx(a.ndim)), f"v {kind.spark}"])
    return NDFrame(spark.createDataFrame(rows, schema), a.shape, kind)


def arange(spark: SparkSession, start, stop=None, step=1, kind=None) -> NDFrame:
    start, stop = (0, start) if stop is None else (start, stop)
    kind = kind or ("float64" if any(isinstance(x, float) for x in (start, stop, step)) else "int64")
    return grid(spark, [max(0, math.ceil((stop - start) / step))], F.lit(start) + F.col("i0") * F.lit(step), kind)


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> NDFrame:
    parts = num - 1 if endpoint else num
    value = F.col("i0") * ((stop - start) / parts if parts else 0.0) + float(start)
    return grid(spark, [num], F.when(F.col("i0") == num - 1, float(stop)).otherwise(value) if endpoint and num > 1 else value)


def logspace(spark: SparkSession, start: float, stop: float, num: int = 50, base: float = 10.0) -> NDFrame:
    return linspace(spark, start, stop, num).map(lambda v: F.pow(F.lit(base), v))


def geomspace(spark: SparkSession, start: float, stop: float, num: int = 50) -> NDFrame:
    if start * stop <= 0:
        raise ValueError("both ends need the same sign and no zero")
    logs = linspace(spark, math.log10(abs(start)), math.log10(abs(stop)), num)
    value = math.copysign(1, start) * F.pow(F.lit(10.0), F.col("v"))
    ends = F.when(F.col("i0") == 0, float(start)).when(F.col("i0") == num - 1, float(stop)).otherwise(value)
    return NDFrame(logs.df.withColumn("v", ends), [num])


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0, kind="float64") -> NDFrame:
    return grid(spark, [n, m or n], F.when(F.col("i1") - F.col("i0") == k, 1).otherwise(0), kind)


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0, kind="float64") -> NDFrame:
    return grid(spark, [n, m or n], F.when(F.col("i1") - F.col("i0") <= k, 1).otherwise(0), kind)


def diag(x: NDFrame, k: int = 0) -> NDFrame:
    """A vector on the k-th diagonal of a matrix, or that diagonal of a matrix."""
    if x.ndim == 2:
        return x.diagonal(k)
    n = x.shape[0] + abs(k)
    base = grid(x.spark, [n, n], F.lit(0), x.dtype)
    on = x.df.select((F.col("i0") + max(-k, 0)).alias("i0"), (F.col("i0") + max(k, 0)).alias("i1"), F.col("v").alias("w"))
    return NDFrame(base.df.join(on, ["i0", "i1"], "left").withColumn("v", F.coalesce("w", "v")), [n, n], x.dtype)


def vander(x: NDFrame, n: int | None = None, increasing: bool = False) -> NDFrame:
    n = x.shape[0] if n is None else n
    wide = x.astype("float64").expand_dims(1).broadcast_to([x.shape[0], n])
    exponent = F.col("i1") if increasing else F.lit(n - 1) - F.col("i1")
    return NDFrame(wide.df.withColumn("v", R.power(F.col("v"), exponent)), wide.shape)


def indices(spark: SparkSession, shape: Sequence[int]) -> list[NDFrame]:
    return [grid(spark, shape, F.col(f"i{k}"), "int64") for k in range(len(shape))]


def meshgrid(*axes: NDFrame, indexing: str = "xy") -> list[NDFrame]:
    shape = [a.shape[0] for a in axes]
    out = [a.reshape([a.shape[0] if j == k else 1 for j in range(len(axes))]).broadcast_to(shape) for k, a in enumerate(axes)]
    return [x.swapaxes(0, 1) for x in out] if indexing == "xy" and len(axes) > 1 else out


def fftfreq(spark: SparkSession, n: int, d: float = 1.0) -> NDFrame:
    k = F.col("i0")
    return grid(spark, [n], F.when(k < (n + 1) // 2, k).otherwise(k - n) / (n * d))


def rfftfreq(spark: SparkSession, n: int, d: float = 1.0) -> NDFrame:
    return grid(spark, [n // 2 + 1], F.col("i0") / (n * d))


def _window(spark: SparkSession, m: int, value) -> NDFrame:
    n = 2 * F.col("i0") + (1 - m)
    return ones(spark, [max(m, 0)]) if m <= 1 else grid(spark, [m], value(n.cast("double")))


def hanning(spark: SparkSession, m: int) -> NDFrame:
    return _window(spark, m, lambda n: 0.5 + 0.5 * F.cos(math.pi * n / (m - 1)))


def hamming(spark: SparkSession, m: int) -> NDFrame:
    return _window(spark, m, lambda n: 0.54 + 0.46 * F.cos(math.pi * n / (m - 1)))


def blackman(spark: SparkSession, m: int) -> NDFrame:
    return _window(spark, m, lambda n: 0.42 + 0.5 * F.cos(math.pi * n / (m - 1)) + 0.08 * F.cos(2 * math.pi * n / (m - 1)))


def bartlett(spark: SparkSession, m: int) -> NDFrame:
    return _window(spark, m, lambda n: F.when(n <= 0, 1 + n / (m - 1)).otherwise(1 - n / (m - 1)))


def kaiser(spark: SparkSession, m: int, beta: float) -> NDFrame:
    return _window(spark, m, lambda n: R.i0(beta * F.sqrt(F.greatest(1 - n * n / (m - 1) ** 2, F.lit(0.0)))) / R.i0(F.lit(beta)))


def of_column(df, value: str, index: str, n: int | None = None) -> NDFrame:
    """A vector of a table's column in the order of a column of places from 0."""
    kind = dtypes.of_spark(dict(df.dtypes)[value])
    return NDFrame(df.select(F.col(index).cast("long").alias("i0"), F.col(value).alias("v")), [df.count() if n is None else n], kind)


def of_arrays(df, column: str, index: str, width: int, n: int | None = None) -> NDFrame:
    """A matrix of an array column: one row a place."""
    rows = df.select(F.col(index).cast("long").alias("i0"), F.posexplode(column).alias("i1", "v"))
    return NDFrame(rows.select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), [df.count() if n is None else n, width])


def diagflat(x: NDFrame, k: int = 0) -> NDFrame:
    """All elements on the k-th diagonal of a matrix."""
    return diag(x.ravel(), k)


def _axis(spark: SparkSession, key: slice) -> NDFrame:
    start = key.start or 0
    if isinstance(key.step, complex):
        return linspace(spark, start, key.stop, int(abs(key.step)))
    return arange(spark, start, key.stop, 1 if key.step is None else key.step)


class Grid:
    """Meshes by slices, ``Grid(spark)[0:3, 0:1:5j]``: full ones, or open ones of size 1 along all other axes."""

    def __init__(self, spark: SparkSession, dense: bool = True):
        self.spark, self.dense = spark, dense

    def __getitem__(self, key) -> list[NDFrame]:
        axes = [_axis(self.spark, k) for k in (key if isinstance(key, tuple) else (key,))]
        if self.dense:
            return meshgrid(*axes, indexing="ij")
        return [a.reshape([a.shape[0] if j == k else 1 for j in range(len(axes))]) for k, a in enumerate(axes)]


def mgrid(spark: SparkSession) -> Grid:
    return Grid(spark)


def ogrid(spark: SparkSession) -> Grid:
    return Grid(spark, dense=False)


class Joiner:
    """Ranges, numbers and arrays put together by an index: ``Joiner(spark)[0:3, 7, x]``, along one axis or as columns."""

    def __init__(self, spark: SparkSession, columns: bool = False):
        self.spark, self.columns = spark, columns

    def __getitem__(self, key) -> NDFrame:
        from .joining import column_stack, concatenate

        parts = [k if isinstance(k, NDFrame) else _axis(self.spark, k) if isinstance(k, slice) else array(self.spark, k if isinstance(k, (list, tuple)) else [k]) for k in (key if isinstance(key, tuple) else (key,))]
        return column_stack(parts) if self.columns else concatenate(parts)


def r_(spark: SparkSession) -> Joiner:
    return Joiner(spark)


def c_(spark: SparkSession) -> Joiner:
    return Joiner(spark, columns=True)


def asarray(spark: SparkSession, x, kind=None) -> NDFrame:
    """An array as it is or cast, anything else as ``array`` makes it."""
    return (x if kind is None else x.astype(kind)) if isinstance(x, NDFrame) else array(spark, x, kind)


def asarray_chkfinite(spark: SparkSession, x, kind=None) -> NDFrame:
    """As asarray; the job fails at an element that isn't finite."""
    out = asarray(spark, x, kind)
    if out.dtype.kind not in "fc":
        return out
    parts = lambda v: [v["re"], v["im"]] if out.dtype.kind == "c" else [v]

    def checked(v: Column) -> Column:
        odd = F.lit(False)
        for p in parts(v):
            odd = odd | F.isnan(p) | (F.abs(p) == float("inf"))
        return F.when(odd, F.raise_error(F.lit("arrays mustn't hold infs or NaNs"))).otherwise(v)

    return out.map(checked)


def copy(x: NDFrame) -> NDFrame:
    """The array itself: nothing can change it."""
    return x


def fromfunction(spark: SparkSession, f, shape: Sequence[int], kind="float64") -> NDFrame:
    """Values by a function of the index columns, which are cast to ``kind``."""
    return grid(spark, shape, f(*(F.col(c).cast(dtype(kind).spark) for c in idx(len(shape)))), kind)


def fromiter(spark: SparkSession, values, kind, count: int = -1) -> NDFrame:
    """From an iterable on the driver."""
    from itertools import islice

    return array(spark, list(values if count < 0 else islice(values, count)), kind)


def frombuffer(spark: SparkSession, buffer: bytes, kind="float64", count: int = -1, offset: int = 0) -> NDFrame:
    """From bytes on the driver."""
    import numpy as np

    return array(spark, np.frombuffer(buffer, dtype(kind).name, count, offset))
