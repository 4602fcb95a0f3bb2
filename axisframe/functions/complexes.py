"""Element-wise functions of complex columns: structs of ``re`` and ``im``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import real as R


def make(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def literal(z: complex) -> Column:
    return make(F.lit(float(z.real)), F.lit(float(z.imag)))


def of_real(x: Column) -> Column:
    return make(x.cast("double"), F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def negative(a: Column) -> Column:
    return make(-a["re"], -a["im"])


def conjugate(a: Column) -> Column:
    return make(a["re"], -a["im"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a: Column, b: Column) -> Column:
    """By the divisor's larger part, so that squares of large parts don't overflow."""
    wide = F.abs(b["re"]) >= F.abs(b["im"])
    big, small = F.when(wide, b["re"]).otherwise(b["im"]), F.when(wide, b["im"]).otherwise(b["re"])
    ratio = R.divide(small, big)
    scale = big + small * ratio
    re = F.when(wide, a["re"] + a["im"] * ratio).otherwise(a["re"] * ratio + a["im"])
    im = F.when(wide, a["im"] - a["re"] * ratio).otherwise(a["im"] * ratio - a["re"])
    zero = (b["re"] == 0) & (b["im"] == 0)
    return make(F.when(zero, R.divide(a["re"], F.abs(b["re"]))).otherwise(R.divide(re, scale)), F.when(zero, R.divide(a["im"], F.abs(b["re"]))).otherwise(R.divide(im, scale)))


def absolute(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column, deg: bool = False) -> Column:
    out = R.arctan2(a["im"], a["re"])
    return F.degrees(out) if deg else out


def exp(a: Column) -> Column:
    r = F.exp(a["re"])
    return make(r * F.cos(a["im"]), F.when(a["im"] == 0, a["im"]).otherwise(r * F.sin(a["im"])))


def log(a: Column) -> Column:
    return make(R.log(absolute(a)), angle(a))


def sqrt(a: Column) -> Column:
    """The root with a real part that isn't negative."""
    r = absolute(a)
    half = F.sqrt((r + F.abs(a["re"])) / 2)
    other = R.divide(F.abs(a["im"]), 2 * half)
    zero = r == 0
    return make(F.when(zero, 0.0).when(a["re"] >= 0, half).otherwise(other), R.copysign(F.when(zero, 0.0).when(a["re"] >= 0, other).otherwise(half), a["im"]))


def power(a: Column, b: Column) -> Column:
    zero = (a["re"] == 0) & (a["im"] == 0)
    none = (b["re"] == 0) & (b["im"] == 0)
    out = exp(multiply(b, log(a)))
    return make(F.when(none, 1.0).when(zero, 0.0).otherwise(out["re"]), F.when(none | zero, 0.0).otherwise(out["im"]))


def equal(a: Column, b: Column) -> Column:
    return R.equal(a["re"], b["re"]) & R.equal(a["im"], b["im"])


def not_equal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def less(a: Column, b: Column) -> Column:
    """Lexicographic."""
    return R.less(a["re"], b["re"]) | (R.equal(a["re"], b["re"]) & R.less(a["im"], b["im"]))


def less_equal(a: Column, b: Column) -> Column:
    return less(a, b) | equal(a, b)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def greater_equal(a: Column, b: Column) -> Column:
    return less_equal(b, a)


# Real arguments outside the real domain give complex results.


def emath_sqrt(x: Column) -> Column:
    return sqrt(of_real(x))


def emath_log(x: Column) -> Column:
    return log(of_real(x))


def emath_logn(n: float, x: Column) -> Column:
    z = log(of_real(x))
    return make(z["re"] / math.log(n), z["im"] / math.log(n))


def emath_log2(x: Column) -> Column:
    return emath_logn(2.0, x)


def emath_log10(x: Column) -> Column:
    return emath_logn(10.0, x)


def emath_power(x: Column, p: Column) -> Column:
    return power(of_real(x), of_real(p))


def emath_arcsin(x: Column) -> Column:
    """-i log(ix + sqrt(1 - x^2))."""
    inside = F.abs(x) <= 1
    big = R.copysign(F.lit(math.pi / 2), x)
    return make(F.when(inside, F.asin(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))).otherwise(big), F.when(inside, 0.0).otherwise(R.copysign(F.acosh(F.greatest(F.abs(x), F.lit(1.0))), x)))


def emath_arccos(x: Column) -> Column:
    z = emath_arcsin(x)
    return make(F.lit(math.pi / 2) - z["re"], -z["im"])


def emath_arctanh(x: Column) -> Column:
    inside = F.abs(x) < 1
    beyond = F.when(F.abs(x) == 1, R.copysign(F.lit(R.INF), x)).otherwise(0.5 * R.log(F.abs(R.divide(1 + x, 1 - x))))
    return make(F.when(inside, F.atanh(F.when(inside, x).otherwise(0.0))).otherwise(beyond), F.when(F.abs(x) <= 1, 0.0).otherwise(R.copysign(F.lit(math.pi / 2), x)))
