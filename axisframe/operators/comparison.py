"""Whether whole arrays agree, and what their elements' types allow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import NDFrame, broadcast_shapes
from ..functions import complexes


def _every(a: NDFrame, b: NDFrame, same) -> bool:
    """Whether ``same`` of the elements holds at every place: one row reaches the driver."""
    got = a.combine(b, same, "bool").df.agg(F.coalesce(F.min("v"), F.lit(True))).first()
    return bool(got[0])


def isclose(a: NDFrame, b: NDFrame, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> NDFrame:
    return a.astype("float64").combine(b.astype("float64"), lambda x, y: _close(x, y, rtol, atol, equal_nan), "bool")


def _close(x: Column, y: Column, rtol: float, atol: float, equal_nan: bool) -> Column:
    inf = float("inf")
    nan = F.isnan(x) | F.isnan(y)
    near = F.when((F.abs(x) == inf) | (F.abs(y) == inf), x == y).otherwise(F.abs(x - y) <= atol + rtol * F.abs(y))
    return F.when(nan, F.isnan(x) & F.isnan(y) if equal_nan else F.lit(False)).otherwise(near)


def allclose(a: NDFrame, b: NDFrame, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> bool:
    return _every(a.astype("float64"), b.astype("float64"), lambda x, y: _close(x, y, rtol, atol, equal_nan))


def _same(a: NDFrame, b: NDFrame, equal_nan: bool = False):
    if "c" in (a.dtype.kind, b.dtype.kind):
        return lambda x, y: complexes.equal(x, y)
    if "f" in (a.dtype.kind, b.dtype.kind):  # NaN differs from itself, unlike in Spark
        return lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y) if equal_nan else F.lit(False)).otherwise(x == y)
    return lambda x, y: x == y


def array_equal(a: NDFrame, b: NDFrame, equal_nan: bool = False) -> bool:
    """Whether two arrays have one shape and equal elements."""
    from ..dtypes import promote

    kind = promote(a.dtype, b.dtype)
    return a.shape == b.shape and _every(a.astype(kind), b.astype(kind), _same(a, b, equal_nan))


def array_equiv(a: NDFrame, b: NDFrame) -> bool:
    """Whether two arrays can be broadcast together and are equal then."""
    try:
        shape = broadcast_shapes(a.shape, b.shape)
    except ValueError:
        return False
    return array_equal(a.broadcast_to(shape), b.broadcast_to(shape))


def real(x: NDFrame) -> NDFrame:
    return x.map(lambda v: v["re"], "float64" if x.dtype.bits == 128 else "float32") if x.dtype.kind == "c" else x


def imag(x: NDFrame) -> NDFrame:
    if x.dtype.kind == "c":
        return x.map(lambda v: v["im"], "float64" if x.dtype.bits == 128 else "float32")
    return x.map(lambda v: F.lit(0).cast(x.dtype.spark))


def iscomplexobj(x: NDFrame) -> bool:
    return x.dtype.kind == "c"


def isrealobj(x: NDFrame) -> bool:
    return x.dtype.kind != "c"


def iscomplex(x: NDFrame) -> NDFrame:
    """Where an element has an imaginary part."""
    return x.map(lambda v: v["im"] != 0 if x.dtype.kind == "c" else F.lit(False), "bool")


def isreal(x: NDFrame) -> NDFrame:
    return ~iscomplex(x)


def real_if_close(x: NDFrame, tol: float = 100) -> NDFrame:
    """The real parts if no imaginary part exceeds ``tol`` units in the last place of 1 (or ``tol`` itself, if it is below 1), else ``x``."""
    if x.dtype.kind != "c":
        return x
    bound = tol * 2.0 ** (-52 if x.dtype.bits == 128 else -23) if tol > 1 else tol
    most = x.df.agg(F.max(F.abs(F.col("v")["im"]))).first()[0]
    return real(x) if most is None or most < bound else x


def isscalar(x) -> bool:
    return isinstance(x, (bool, int, float, complex, str, bytes))


def iterable(x) -> bool:
    return x.ndim > 0 if isinstance(x, NDFrame) else hasattr(x, "__iter__")
