"""Element-wise functions of real columns.

SQL and IEEE arithmetic differ where SQL raises or gives NULL (division by
zero, logarithms, overflow) and where it orders NaN.  These functions never
give NULL for values that aren't NULL, whatever ``spark.sql.ansi.enabled`` is.
Functions named ``int_*`` are for whole numbers of a given type, the others
for floats.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dtypes import DTYPES, DType, limits, wrapped

NAN, INF = float("nan"), float("inf")


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


# Arithmetic


def signbit(x) -> Column:
    """Whether the sign bit is set; of zeros, -0.0 has it (1 / -0.0 is negative)."""
    x = _d(x)
    return (x < 0) | ((x == 0) & (F.pow(x, F.lit(-1.0)) < 0))


def divide(a, b) -> Column:
    a, b = _d(a), _d(b)
    zero = F.when(F.isnan(a) | (a == 0), NAN).when(signbit(a) != signbit(b), -INF).otherwise(INF)
    return F.when(b == 0, zero).otherwise(a / b)


def fmod(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when((b == 0) | F.isnan(b) | F.isnan(a) | (F.abs(a) == INF), NAN).when(F.abs(b) == INF, a).otherwise(a % b)


def remainder(a, b) -> Column:
    """The remainder with the divisor's sign."""
    a, b = _d(a), _d(b)
    m = fmod(a, b)
    return F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


def floor_divide(a, b) -> Column:
    a, b = _d(a), _d(b)
    m = fmod(a, b)
    q = divide(a - m, b)
    q = F.when((m != 0) & ((m < 0) != (b < 0)), q - 1).otherwise(q)
    near = floor(q)
    return F.when(b == 0, divide(a, b)).when(F.isnan(q), NAN).when(q - near > 0.5, near + 1).otherwise(near)


def power(a, b) -> Column:
    """By the C library in extended precision, so that the nearest float comes out; the JVM's power is one off for one in 14."""
    import numpy as np

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            v = np.power(a.to_numpy(zero_copy_only=False).astype(np.longdouble), b.to_numpy(zero_copy_only=False)).astype(float)
        return pa.array(v, mask=pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))

    return run(_d(a), _d(b))


def sign(x) -> Column:
    x = _d(x)
    return F.when(F.isnan(x), x).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(x)


def square(x) -> Column:
    return _d(x) * _d(x)


def reciprocal(x) -> Column:
    return divide(1.0, x)


def copysign(a, b) -> Column:
    return F.when(signbit(b), -F.abs(_d(a))).otherwise(F.abs(_d(a)))


def heaviside(x, h) -> Column:
    x = _d(x)
    return F.when(F.isnan(x), x).when(x == 0, _d(h)).when(x < 0, 0.0).otherwise(1.0)


def maximum(a, b) -> Column:
    return F.greatest(_d(a), _d(b))  # NaN is the largest


def minimum(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(F.least(a, b))


def fmax(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a, b) -> Column:
    return F.least(_d(a), _d(b))


def clip(x, lo=None, hi=None) -> Column:
    """minimum(maximum(x, lo), hi): the upper bound wins, NaN anywhere stays."""
    x = _d(x)
    x = maximum(x, lo) if lo is not None else x
    return minimum(x, hi) if hi is not None else x


def hypot(a, b) -> Column:
    return F.hypot(_d(a), _d(b))


def ldexp(x, n) -> Column:
    """x * 2**n in two steps, so that subnormal results don't pass through an infinite factor."""
    n = _c(n).cast("int")
    half = F.floor(n / 2).cast("int")
    return _d(x) * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (n - half).cast("double"))


def modf(x) -> Column:
    """(fractional, integral), both with the sign of x."""
    x = _d(x)
    whole = trunc(x)
    return F.struct(F.when(F.abs(x) == INF, copysign(0.0, x)).otherwise(copysign(x - whole, x)).alias("fractional"), whole.alias("integral"))


def divmod_(a, b) -> Column:
    return F.struct(floor_divide(a, b).alias("quotient"), remainder(a, b).alias("remainder"))


# Rounding

_WHOLE = 2.0**52


def _rounded(x: Column, small: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= _WHOLE) | (x == 0), x).otherwise(copysign(small.cast("double"), x))


def floor(x) -> Column:
    x = _d(x)
    return F.when(F.isnan(x) | (F.abs(x) >= _WHOLE) | (x == 0), x).otherwise(F.floor(x).cast("double"))


def ceil(x) -> Column:
    x = _d(x)
    return _rounded(x, F.ceil(x))


def trunc(x) -> Column:
    x = _d(x)
    return _rounded(x, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


fix = trunc


def rint(x) -> Column:
    return F.rint(_d(x))


def round_(x, decimals: int = 0) -> Column:
    """rint of the scaled value: halves go to even."""
    x, scale = _d(x), 10.0 ** abs(decimals)
    return F.rint(x) if not decimals else F.rint(x * scale) / scale if decimals > 0 else F.rint(x / scale) * scale


# Exponentials and logarithms


def _log(f, x) -> Column:
    x = _d(x)
    return F.when(x == 0, -INF).when((x < 0) | F.isnan(x), NAN).otherwise(f(x))


def log(x) -> Column:
    return _log(F.ln, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def log1p(x) -> Column:
    x = _d(x)
    return F.when(x == -1, -INF).when((x < -1) | F.isnan(x), NAN).otherwise(F.log1p(x))


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), _d(x))


def logaddexp(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(a == b, a + math.log(2)).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def logaddexp2(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(a == b, a + 1).otherwise(F.greatest(a, b) + F.log1p(exp2(-F.abs(a - b))) / math.log(2))


def sinc(x) -> Column:
    y = math.pi * _d(x)
    return F.when(y == 0, 1.0).otherwise(F.sin(y) / y)


def i0(x, terms: int = 60) -> Column:
    """Modified Bessel function of the first kind and order 0, by its power series."""
    q = square(x) / 4
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def more(s, k):
        term = s["term"] * q / (k * k)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: k.cast("double")), start, more, lambda s: s["sum"])


def arctan2(y, x) -> Column:
    y, x = _d(y), _d(x)
    return F.when((y == 0) & (signbit(x)), F.when(signbit(y), -math.pi).otherwise(math.pi)).otherwise(F.atan2(y, x))


def nan_to_num(x, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Column:
    x, most = _d(x), 1.7976931348623157e308
    return F.when(F.isnan(x), nan).when(x == INF, most if posinf is None else posinf).when(x == -INF, -most if neginf is None else neginf).otherwise(x)


# Predicates


def equal(a, b) -> Column:
    return (_c(a) == _c(b)) & ~F.isnan(_d(a))


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def less(a, b) -> Column:
    return (_c(a) < _c(b)) & ~F.isnan(_d(b))


def less_equal(a, b) -> Column:
    return (_c(a) <= _c(b)) & ~F.isnan(_d(b))


def greater(a, b) -> Column:
    return less(b, a)


def greater_equal(a, b) -> Column:
    return less_equal(b, a)


def truth(x) -> Column:
    """NaN is true."""
    return _d(x) != 0


def logical_and(a, b) -> Column:
    return truth(a) & truth(b)


def logical_or(a, b) -> Column:
    return truth(a) | truth(b)


def logical_xor(a, b) -> Column:
    return truth(a) != truth(b)


def logical_not(a) -> Column:
    return ~truth(a)


def isinf(x) -> Column:
    return F.abs(_d(x)) == INF


def isposinf(x) -> Column:
    return _d(x) == INF


def isneginf(x) -> Column:
    return _d(x) == -INF


def isfinite(x) -> Column:
    return F.abs(_d(x)) < INF


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = _d(a), _d(b)
    near = isfinite(b) & isfinite(a) & (F.abs(a - b) <= atol + rtol * F.abs(b))
    near = near | equal(a, b)
    return near | (F.isnan(a) & F.isnan(b)) if equal_nan else near


# Whole numbers


def _exact(a, b, f) -> Column:
    return f(_c(a).cast("decimal(38,0)"), _c(b).cast("decimal(38,0)"))


def int_add(a, b, t: DType = DTYPES["int64"]) -> Column:
    return wrapped(_exact(a, b, lambda x, y: x + y), t) if t.bits < 64 or t.kind == "u" else F.coalesce(F.try_add(_c(a), _c(b)), wrapped(_exact(a, b, lambda x, y: x + y), t))


def int_subtract(a, b, t: DType = DTYPES["int64"]) -> Column:
    return wrapped(_exact(a, b, lambda x, y: x - y), t) if t.bits < 64 or t.kind == "u" else F.coalesce(F.try_subtract(_c(a), _c(b)), wrapped(_exact(a, b, lambda x, y: x - y), t))


def int_multiply(a, b, t: DType = DTYPES["int64"]) -> Column:
    """The product modulo the type's size: of 64-bit factors that overflow, from 32-bit halves."""
    if t.bits <= 32:
        return wrapped(_c(a).cast("decimal(19,0)") * _c(b).cast("decimal(19,0)"), t)
    a, b = _c(a).cast("decimal(20,0)"), _c(b).cast("decimal(20,0)")
    half = F.lit(1 << 32).cast("decimal(20,0)")
    low = (b % half).cast("decimal(11,0)")
    high = ((b - low) / half).cast("decimal(20,0)")
    upper = wrapped(wrapped(a * high.cast("decimal(11,0)"), DTYPES["int64"]).cast("decimal(20,0)") % half.cast("decimal(20,0)") * half.cast("decimal(11,0)"), DTYPES["int64"])
    slow = wrapped(upper.cast("decimal(38,0)") + wrapped(a * low, DTYPES["int64"]).cast("decimal(38,0)"), t)
    return slow if t.kind == "u" else F.coalesce(F.try_multiply(a.cast("bigint"), b.cast("bigint")), slow)


def int_floor_divide(a, b, t: DType = DTYPES["int64"]) -> Column:
    """Towards minus infinity; by zero it is 0, and the least number by -1 stays itself."""
    a, b = _c(a), _c(b)
    safe = F.when((b == 0) | ((a == limits(t)[0]) & (b == -1)), F.lit(1)).otherwise(b)
    q = F.call_function("div", a.cast("bigint"), safe.cast("bigint"))
    m = a.cast("bigint") % safe.cast("bigint")
    q = F.when((m != 0) & ((m < 0) != (safe < 0)), q - 1).otherwise(q)
    return F.when(b == 0, F.lit(0)).when((a == limits(t)[0]) & (b == -1), a).otherwise(q).cast(t.spark)


def int_fmod(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(b == 0, F.lit(0)).otherwise(a % F.when(b == 0, F.lit(1)).otherwise(b))


def int_remainder(a, b) -> Column:
    m = int_fmod(a, b)
    return F.when((m != 0) & ((m < 0) != (_c(b) < 0)), m + _c(b)).otherwise(m)


def int_power(a, n: int, t: DType = DTYPES["int64"]) -> Column:
    """a ** n for a known n >= 0, by squaring, modulo the type's size."""
    if n < 0:
        raise ValueError("whole numbers have no negative whole powers")
    bits = F.array(*(F.lit(int(b)) for b in f"{n:b}"))

    def step(power: Column, bit: Column) -> Column:
        return let(int_multiply(power, power, t), lambda s: F.when(bit == 1, int_multiply(s, _c(a), t)).otherwise(s))

    return F.aggregate(bits, F.lit(1).cast(t.spark), step)


def gcd(a, b) -> Column:
    """Euclid's algorithm: 64-bit numbers need at most 92 steps."""
    start = F.struct(F.abs(_c(a).cast("bigint")).alias("x"), F.abs(_c(b).cast("bigint")).alias("y"))

    def step(s, _):
        rest = F.when(s["y"] == 0, F.lit(0)).otherwise(s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).cast("bigint")
        return F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), rest.alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a, b) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0)).otherwise(int_multiply(F.call_function("div", F.abs(_c(a).cast("bigint")), F.when(g == 0, F.lit(1)).otherwise(g)), F.abs(_c(b).cast("bigint"))))


def left_shift(a, n, t: DType = DTYPES["int64"]) -> Column:
    n = _c(n).cast("int")
    return F.when((n < 0) | (n >= t.bits), F.lit(0)).otherwise(F.call_function("shiftleft", _c(a).cast("bigint"), F.least(F.greatest(n, F.lit(0)), F.lit(63)))).cast(t.spark)


def right_shift(a, n, t: DType = DTYPES["int64"]) -> Column:
    n = _c(n).cast("int")
    over = F.when(_c(a) < 0, F.lit(-1)).otherwise(F.lit(0))
    return F.when((n < 0) | (n >= t.bits), over).otherwise(F.call_function("shiftright", _c(a).cast("bigint"), F.least(F.greatest(n, F.lit(0)), F.lit(63)))).cast(t.spark)


def bitwise_count(a) -> Column:
    """One bits of the absolute value."""
    return F.bit_count(F.abs(_c(a).cast("bigint")))


def binary_repr(a, width: int | None = None) -> Column:
    """Binary digits; a negative number has a minus sign, or with a width its two's complement."""
    a = _c(a).cast("bigint")
    if width is None:
        return F.when(a < 0, F.concat(F.lit("-"), F.bin(-a))).otherwise(F.bin(a))
    return F.when(a < 0, F.substring(F.bin(a), 65 - width, width)).otherwise(F.lpad(F.bin(a), width, "0"))


def base_repr(a, base: int) -> Column:
    a = _c(a).cast("bigint")
    return F.when(a < 0, F.concat(F.lit("-"), F.conv(F.abs(a).cast("string"), 10, base))).otherwise(F.conv(a.cast("string"), 10, base))


# What only numpy has; Arrow batches

def _vectorised(f, kind: str):
    @F.pandas_udf(kind)
    def run(*own: pd.Series) -> pd.Series:
        return pd.Series(f(*(x.to_numpy() for x in own)))

    return run


def nextafter(a, b) -> Column:
    import numpy as np

    return _vectorised(np.nextafter, "double")(_d(a), _d(b))


def spacing(x) -> Column:
    import numpy as np

    return _vectorised(np.spacing, "double")(_d(x))


def frexp(x) -> Column:
    """(mantissa, exponent)."""
    import numpy as np

    @F.pandas_udf("mantissa double, exponent int")
    def run(x: pd.Series) -> pd.DataFrame:
        m, e = np.frexp(x.to_numpy())
        return pd.DataFrame({"mantissa": m, "exponent": e.astype("int32")})

    return run(_d(x))


def interp(x, xp: list[float], fp: list[float], left: float | None = None, right: float | None = None) -> Column:
    """Piecewise linear between fixed knots, found by halving the knot array."""
    x, knots, values = _d(x), F.array(*map(F.lit, map(float, xp))), F.array(*map(F.lit, map(float, fp)))
    k = F.least(F.greatest(digitize(x, xp) - 1, F.lit(0)), F.lit(len(xp) - 2))
    x0, x1, y0, y1 = F.get(knots, k), F.get(knots, k + 1), F.get(values, k), F.get(values, k + 1)
    inside = divide(y1 - y0, x1 - x0) * (x - x0) + y0
    lo, hi = fp[0] if left is None else left, fp[-1] if right is None else right
    return F.when(F.isnan(x), x).when(x < xp[0], float(lo)).when(x > xp[-1], float(hi)).when(x == xp[-1], float(fp[-1])).otherwise(inside)


def digitize(x, bins: list[float], right: bool = False) -> Column:
    """How many bins' edges are at most x (below x with ``right``); falling edges count from the other end."""
    x = _d(x)
    rising = bins[0] <= bins[-1] if bins else True
    edges = F.array(*map(F.lit, map(float, bins))) if bins else F.array().cast("array<double>")
    if rising:
        return F.size(F.filter(edges, lambda e: (e < x) if right else (e <= x)))
    return F.size(F.filter(edges, lambda e: (e >= x) if right else (e > x)))
