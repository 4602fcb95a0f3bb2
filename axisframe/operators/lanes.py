"""Scans, differences and interpolation along ordered lanes of a table.

A lane is the rows of one key in the order of another column; lanes are
divided among tasks by their key.  For one lane that is the whole table, use
``NDFrame.scan``, which works in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..frame import BROADCAST_ELEMENTS, NDFrame, normal_axis
from ..functions import complexes as C
from ..functions import real as R
from ..storage import numbered, ready
from . import selection
from .fourier import irfft, rfft

#: Places of a block when a vector is convolved with a table.
CONVOLVED = 1 << 15


def lane(by: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def cumsum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(_running(w))


def cumprod(x: Column, w: WindowSpec) -> Column:
    return F.product(x.cast("double")).over(_running(w))


def nancumsum(x: Column, w: WindowSpec) -> Column:
    return F.sum(F.nanvl(x.cast("double"), F.lit(0.0))).over(_running(w))


def nancumprod(x: Column, w: WindowSpec) -> Column:
    return F.product(F.nanvl(x.cast("double"), F.lit(1.0))).over(_running(w))


def cummax(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(_running(w))


def cummin(x: Column, w: WindowSpec) -> Column:
    return F.min(x).over(_running(w))


def diff(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """The n-th difference; NULL for a lane's first n rows, which have none."""
    terms = [F.lag(x, k).over(w) * ((-1) ** k * math.comb(n, k)) for k in range(1, n + 1)]
    out = x
    for t in terms:
        out = out + t
    return out


def gradient(x: Column, w: WindowSpec, spacing: float = 1.0, edge_order: int = 1) -> Column:
    """Central differences, one-sided ones of the given order at both ends."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    if edge_order == 1:
        first, last = (after - x) / spacing, (x - before) / spacing
    else:
        two_on, two_back = F.lead(x, 2).over(w), F.lag(x, 2).over(w)
        first, last = (-1.5 * x + 2 * after - 0.5 * two_on) / spacing, (1.5 * x - 2 * before + 0.5 * two_back) / spacing
    return F.when(before.isNull(), first).when(after.isNull(), last).otherwise((after - before) / (2 * spacing))


def gradient_at(x: Column, place: Column, w: WindowSpec) -> Column:
    """The gradient at uneven places: weights of second order inside, one-sided at both ends."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    left, right = place - F.lag(place).over(w), F.lead(place).over(w) - place
    inside = (after * left * left - before * right * right + x * (right * right - left * left)) / (left * right * (left + right))
    return F.when(before.isNull(), (after - x) / right).when(after.isNull(), (x - before) / left).otherwise(inside)


def trapezoid(df: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """The integral of each lane by the trapezoidal rule."""
    w = lane(by, [place])
    area = (F.col(place) - F.lag(place).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return df.select(*by, area.alias("_area")).groupBy(*by).agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("integral"))


def unwrap(df: DataFrame, by: list[str], order: list[str], value: str, period: float = 2 * math.pi, discont: float | None = None) -> DataFrame:
    """``df`` with ``unwrapped``: jumps of more than ``discont`` (half a period) are brought below it by whole periods."""
    w, half = lane(by, order), period / 2
    step = F.col(value) - F.lag(value).over(w)
    fitted = R.remainder(step + half, period) - half
    fitted = F.when((fitted == -half) & (step > 0), half).otherwise(fitted)
    fix = F.when(F.abs(step) < (half if discont is None else max(discont, half)), 0.0).otherwise(fitted - step)
    out = df.withColumn("_fix", F.coalesce(fix, F.lit(0.0)))
    return out.withColumn("unwrapped", F.col(value) + F.sum("_fix").over(_running(w))).drop("_fix")


def convolve(x: Column, kernel: list[float], w: WindowSpec) -> Column:
    """The first len(lane) values of the full convolution with a short fixed kernel."""
    out = x * kernel[0]
    for k, c in enumerate(kernel[1:], 1):
        out = out + F.coalesce(F.lag(x, k).over(w), F.lit(0.0)) * c
    return out


def ediff1d(df: DataFrame, order: list[str], value: str, to_begin: list[float] = (), to_end: list[float] = ()) -> DataFrame:
    """pos and v: the differences of neighbours along a whole column, between values put before and behind them.

    Places are numbered by ranges, and each value meets its follower by a join
    on the place, so no task gets the whole column.
    """
    placed = numbered(df.select(*order, F.col(value).alias("_v")), [F.col(c) for c in order])
    n, lead = placed.count(), len(to_begin)
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("_v").alias("_next"))
    inner = placed.select("pos", "_v").join(after, "pos").select((F.col("pos") + lead).alias("pos"), (F.col("_next") - F.col("_v")).cast("double").alias("v"))
    ends = [(k, float(v)) for k, v in enumerate(to_begin)] + [(lead + max(n - 1, 0) + k, float(v)) for k, v in enumerate(to_end)]
    return inner.union(df.sparkSession.createDataFrame(ends, "pos long, v double")) if ends else inner


def _blocks(x: NDFrame, name: str, size: int) -> DataFrame:
    """The vector in blocks of ``size`` places: their number and their bytes."""

    def pack(key, t):
        out = np.zeros(size)
        out[t["at"].to_numpy()] = t["v"].to_numpy()
        return pa.table({name: pa.array([key[0].as_py()], pa.int64()), f"{name}_data": pa.array([out.tobytes()], pa.binary())})

    rows = x.df.select(F.floor(F.col("i0") / size).cast("long").alias(name), (F.col("i0") % size).alias("at"), F.col("v").cast("double").alias("v"))
    return rows.groupBy(name).applyInArrow(pack, f"{name} long, {name}_data binary")


def _added(x: NDFrame, kernel: NDFrame, size: int) -> DataFrame:
    """The full convolution by overlap and add: each block of x meets the kernel's blocks, and what lands in one block is added."""
    m = kernel.shape[0]

    def spread(batches):
        for t in batches:
            out = {}
            for a, x_data, b, k_data in zip(*(c.to_pylist() for c in t.columns)):
                both = np.fft.irfft(np.fft.rfft(np.frombuffer(x_data), 2 * size) * np.fft.rfft(np.frombuffer(k_data), 2 * size), 2 * size)
                for place, part in ((a + b, both[:size]), (a + b + 1, both[size:])):
                    out[place] = out[place] + part if place in out else part
            yield pa.RecordBatch.from_pydict({"b": pa.array(list(out), pa.int64()), "data": pa.array([v.tobytes() for v in out.values()], pa.binary())}, pa.schema([("b", pa.int64()), ("data", pa.binary())]))

    def add(key, t):
        total = np.zeros(size)
        for data in t["data"]:
            total += np.frombuffer(data.as_py())
        return pa.table({"i0": key[0].as_py() * size + np.arange(size), "v": total})

    # The kernel's size is known and bounded by BROADCAST_ELEMENTS.
    pairs = _blocks(x, "a", size).crossJoin(F.broadcast(_blocks(kernel, "b", size)))
    rows = pairs.mapInArrow(spread, "b long, data binary").groupBy("b").applyInArrow(add, "i0 long, v double")
    return rows.filter(F.col("i0") < x.shape[0] + m - 1)


def _full(x: NDFrame, kernel: NDFrame) -> DataFrame:
    """The full convolution of two vectors: by blocks if one of them is short enough to be sent to all tasks, else as a product of spectra."""
    n, m = x.shape[0], kernel.shape[0]
    ready(x.spark)
    if n < m:
        x, kernel = kernel, x
    if min(n, m) <= BROADCAST_ELEMENTS:
        return _added(x, kernel, CONVOLVED)
    size = 1 << (n + m - 2).bit_length()
    both = rfft(x.astype("float64"), size).combine(rfft(kernel.astype("float64"), size), C.multiply, "complex128")
    return irfft(both, size).df.filter(F.col("i0") < n + m - 1)


def convolve1d(x: NDFrame, kernel: list[float] | NDFrame, mode: str = "full") -> NDFrame:
    """The convolution of a vector with a kernel: full, as long as the longer, or only where both overlap whole.

    With a kernel on the driver, each element is sent to the places it counts
    for, and places are summed; a kernel that is a vector itself may be as long
    as the other.
    """
    if isinstance(kernel, NDFrame):
        m, spread = kernel.shape[0], _full(x, kernel)
    else:
        m = len(kernel)
        terms = F.posexplode(F.array(*(F.lit(float(c)) for c in kernel))).alias("_k", "_c")
        spread = x.df.select("i0", "v", terms).groupBy((F.col("i0") + F.col("_k")).alias("i0")).agg(F.sum(F.col("v") * F.col("_c")).alias("v"))
    n = x.shape[0]
    size = {"full": n + m - 1, "same": max(n, m), "valid": max(n, m) - min(n, m) + 1}[mode]
    first = {"full": 0, "same": (min(n, m) - 1) // 2, "valid": min(n, m) - 1}[mode]
    own = spread.filter((F.col("i0") >= first) & (F.col("i0") < first + size))
    return NDFrame(own.select((F.col("i0") - first).alias("i0"), "v"), [size])


def correlate(x: NDFrame, kernel: list[float] | NDFrame, mode: str = "valid") -> NDFrame:
    """The cross-correlation of a vector with a kernel: the convolution with the kernel turned round."""
    table = isinstance(kernel, NDFrame)
    turned, m = (kernel.flip(), kernel.shape[0]) if table else (kernel[::-1], len(kernel))
    out = convolve1d(x, turned, mode)
    if mode != "same" or x.shape[0] >= m:
        return out
    full = convolve1d(x, turned, "full")  # of a longer kernel the middle lies the other way
    first, size = x.shape[0] // 2, m
    return NDFrame(full.df.filter((F.col("i0") >= first) & (F.col("i0") < first + size)).select((F.col("i0") - first).alias("i0"), "v"), [size])


def accumulate(x: NDFrame, f, merge, axis: int = 0, kind=None) -> NDFrame:
    """Running results of an associative aggregate ``f`` along an axis, block totals of which ``merge`` puts together."""
    return x.scan(f, merge, axis, kind)


def reduceat(x: NDFrame, places: list[int], f) -> NDFrame:
    """Aggregates of a vector from each place up to the next; of a place that isn't below the next its element alone."""
    n = x.shape[0]
    if any(not 0 <= p < n for p in places):
        raise IndexError("a place is out of bounds")
    ends = [*places[1:], n]
    spans = [(k, a, b if a < b else a + 1) for k, (a, b) in enumerate(zip(places, ends))]
    table = F.broadcast(x.spark.createDataFrame(spans, "_k long, _a long, _b long"))
    rows = x.df.join(table, (F.col("i0") >= F.col("_a")) & (F.col("i0") < F.col("_b")))
    return NDFrame(rows.groupBy(F.col("_k").alias("i0")).agg(f(F.col("v")).alias("v")), [len(places)], x.dtype)


def at(x: NDFrame, places: DataFrame, f, merge) -> NDFrame:
    """A copy of a vector in which each place of ``places`` (i0, v) has taken in all its values.

    Values of one place are aggregated by ``f`` before they move, and
    ``merge`` puts what is there and the aggregate together.
    """
    new = places.groupBy("i0").agg(f(F.col("v")).alias("_n"))
    both = x.df.join(new, "i0", "left")
    return NDFrame(both.withColumn("v", F.when(F.col("_n").isNull(), F.col("v")).otherwise(merge(F.col("v"), F.col("_n")))), x.shape, x.dtype)


def apply_over_axes(f, x: NDFrame, axes: list[int]) -> NDFrame:
    """Reduces one axis after the other, each of which stays with size 1."""
    for axis in axes:
        x = x.reduce(f, axis=axis, keepdims=True)
    return x


def sorted_lanes(x: NDFrame, axis: int = -1) -> NDFrame:
    """Each lane along an axis in rising order, NaNs last; complex numbers by their real parts, then imaginary ones."""
    axis = normal_axis(axis, x.ndim)
    others = [f"i{k}" for k in range(x.ndim) if k != axis]
    w = Window.partitionBy(*others).orderBy("v")
    return NDFrame(x.df.withColumn(f"i{axis}", (F.row_number().over(w) - 1).cast("long")), x.shape, x.dtype)


def partition(x: NDFrame, kth: int, axis: int = -1) -> NDFrame:
    """Lanes in which nothing before place ``kth`` is larger, nothing after it smaller: short lanes are sorted, long ones only divided."""
    axis = normal_axis(axis, x.ndim)
    normal_axis(kth, x.shape[axis])
    if x.shape[axis] <= selection.WHOLE:
        return sorted_lanes(x, axis)
    return NDFrame(selection.arranged(x, kth, axis).df, x.shape, x.dtype)


def argpartition(x: NDFrame, kth: int, axis: int = -1) -> NDFrame:
    """The places that partition lanes; equal values in the order of their places."""
    axis = normal_axis(axis, x.ndim)
    normal_axis(kth, x.shape[axis])
    if x.shape[axis] > selection.WHOLE:
        return NDFrame(selection.arranged(x, kth, axis).df.withColumn("v", F.col("_from")), x.shape, "int64")
    others = [f"i{k}" for k in range(x.ndim) if k != axis]
    w = Window.partitionBy(*others).orderBy("v", f"i{axis}")
    rows = x.df.select(*others, F.col(f"i{axis}").alias("_from"), (F.row_number().over(w) - 1).cast("long").alias(f"i{axis}"))
    return NDFrame(rows.withColumn("v", F.col("_from")), x.shape, "int64")


def sort_complex(x: NDFrame) -> NDFrame:
    """All elements as complex numbers in rising order along one axis."""
    flat = x.astype("complex128").ravel()
    ranked = numbered(flat.df.select("v", F.col("i0")), [F.col("v")["re"], F.col("v")["im"], F.col("i0")])
    return NDFrame(ranked.select(F.col("pos").alias("i0"), "v"), [x.size], "complex128")
