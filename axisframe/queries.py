"""Queries of the array operators and the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import NDFrame
from .functions import complexes as C
from .functions import polynomials
from .functions import real as R
from .operators import aggregates as A
from .operators import contractions, creation, histograms, joining, lanes, quantiles, sets, stacks
from .operators.random import default_rng
from .plans.einsum import einsum
from .storage import numbered, small_side

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _near(c: Column) -> Column:
    """Seven decimals, without a negative zero: what two mathematical libraries agree on.

    As SQL rounds them, halves of the product with ten million away from zero;
    Spark's own rounding goes by decimal digits, so it differs at halves and
    beyond the digits that a product holds.
    """
    scaled = c * 1e7
    return F.when(R.isinf(scaled), c).otherwise(F.round(scaled) / 1e7) + 0.0


# Flagship: revenue by return flag


@_query("revenue_by_flag", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    return line.groupBy("l_returnflag").agg(F.round(A.sum_(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


# Element-wise functions, each over all orders: x and y are floats of both signs, i and j whole numbers, z = x + iy.

_OPERANDS = """(SELECT o_orderkey AS k, (o_totalprice - 150000.0) / 50000.0 AS x, (o_custkey % 17 - 8) / 4.0 AS y, CAST(o_custkey % 1000 - 500 AS BIGINT) AS i, CAST(o_orderkey % 13 - 6 AS BIGINT) AS j FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_custkey FROM orders))"""


def _operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), ((F.col("o_totalprice") - 150000.0) / 50000.0).alias("x"), ((F.col("o_custkey") % 17 - 8) / F.lit(4.0)).alias("y"), (F.col("o_custkey") % 1000 - 500).alias("i"), (F.col("o_orderkey") % 13 - 6).alias("j"))


def x() -> Column:
    return F.col("x")


def y() -> Column:
    return F.col("y")


def i() -> Column:
    return F.col("i")


def j() -> Column:
    return F.col("j")


_FLOOR = "(CASE WHEN y = 0 THEN CASE WHEN x > 0 THEN 'inf'::DOUBLE WHEN x < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE floor(x / y) END)"
_MOD = "(CASE WHEN y = 0 THEN 'nan'::DOUBLE ELSE x % y END)"
#: name: (column expression, SQL expression) of floats
FLOAT_FUNCTIONS = {
    "add": (lambda: x() + y(), "x + y"),
    "subtract": (lambda: x() - y(), "x - y"),
    "multiply": (lambda: x() * y(), "x * y"),
    "divide": (lambda: R.divide(x(), y()), "CASE WHEN y = 0 THEN CASE WHEN x > 0 THEN 'inf'::DOUBLE WHEN x < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE x / y END"),
    "floor_divide": (lambda: R.floor_divide(x(), y()), _FLOOR),
    "remainder": (lambda: R.remainder(x(), y()), f"CASE WHEN y = 0 THEN 'nan'::DOUBLE WHEN {_MOD} <> 0 AND ({_MOD} < 0) <> (y < 0) THEN {_MOD} + y ELSE {_MOD} END"),
    "fmod": (lambda: R.fmod(x(), y()), _MOD),
    "power": (lambda: R.power(F.abs(x()), y()), "CASE WHEN abs(x) = 1 THEN 1.0 ELSE pow(abs(x), y) END"),
    "float_power": (lambda: R.power(F.abs(x()) + 1, y()), "pow(abs(x) + 1, y)"),
    "absolute": (lambda: F.abs(x()), "abs(x)"),
    "fabs": (lambda: F.abs(i().cast("double")), "CAST(abs(i) AS DOUBLE)"),
    "negative": (lambda: -x(), "-x"),
    "positive": (lambda: +1 * x(), "x"),
    "sign": (lambda: R.sign(x()), "CAST(sign(x) AS DOUBLE)"),
    "square": (lambda: R.square(x()), "x * x"),
    "reciprocal": (lambda: R.reciprocal(y() + 0.125), "1 / (y + 0.125)"),
    "sqrt": (lambda: F.sqrt(x()), "CASE WHEN x < 0 THEN 'nan'::DOUBLE ELSE sqrt(abs(x)) END"),
    "cbrt": (lambda: F.cbrt(x()), "cbrt(x)"),
    "hypot": (lambda: R.hypot(x(), y()), "sqrt(x * x + y * y)"),
    "maximum": (lambda: R.maximum(x(), y()), "greatest(x, y)"),
    "minimum": (lambda: R.minimum(x(), y()), "least(x, y)"),
    "fmax": (lambda: R.fmax(F.when(j() == 0, float("nan")).otherwise(x()), y()), "CASE WHEN j = 0 THEN y ELSE greatest(x, y) END"),
    "fmin": (lambda: R.fmin(F.when(j() == 0, float("nan")).otherwise(x()), y()), "CASE WHEN j = 0 THEN y ELSE least(x, y) END"),
    "heaviside": (lambda: R.heaviside(y(), x()), "CASE WHEN y = 0 THEN x WHEN y < 0 THEN 0.0 ELSE 1.0 END"),
    "copysign": (lambda: R.copysign(x(), y()), "CASE WHEN y < 0 THEN -abs(x) ELSE abs(x) END"),
    "ldexp": (lambda: R.ldexp(x(), j()), "x * pow(2.0, j)"),
    "modf_fractional": (lambda: R.modf(x())["fractional"], "x - trunc(x)"),
    "modf_integral": (lambda: R.modf(x())["integral"], "trunc(x)"),
    "divmod_quotient": (lambda: R.divmod_(x(), y())["quotient"], _FLOOR),
    "exp": (lambda: F.exp(x()), "exp(x)"),
    "exp2": (lambda: R.exp2(x()), "pow(2.0, x)"),
    "expm1": (lambda: F.expm1(x()), "exp(x) - 1"),
    "log": (lambda: R.log(y()), "CASE WHEN y = 0 THEN '-inf'::DOUBLE WHEN y < 0 THEN 'nan'::DOUBLE ELSE ln(CASE WHEN y > 0 THEN y ELSE 1 END) END"),
    "log2": (lambda: R.log2(y()), "CASE WHEN y = 0 THEN '-inf'::DOUBLE WHEN y < 0 THEN 'nan'::DOUBLE ELSE log2(CASE WHEN y > 0 THEN y ELSE 1 END) END"),
    "log10": (lambda: R.log10(y()), "CASE WHEN y = 0 THEN '-inf'::DOUBLE WHEN y < 0 THEN 'nan'::DOUBLE ELSE log10(CASE WHEN y > 0 THEN y ELSE 1 END) END"),
    "log1p": (lambda: R.log1p(y()), "CASE WHEN y = -1 THEN '-inf'::DOUBLE WHEN y < -1 THEN 'nan'::DOUBLE ELSE ln(CASE WHEN y > -1 THEN 1 + y ELSE 1 END) END"),
    "logaddexp": (lambda: R.logaddexp(x(), y()), "greatest(x, y) + ln(1 + exp(-abs(x - y)))"),
    "logaddexp2": (lambda: R.logaddexp2(x(), y()), "greatest(x, y) + log2(1 + pow(2.0, -abs(x - y)))"),
    "sin": (lambda: F.sin(x()), "sin(x)"),
    "cos": (lambda: F.cos(x()), "cos(x)"),
    "tan": (lambda: F.tan(y()), "tan(y)"),
    "arcsin": (lambda: F.asin(y() / 2), "asin(y / 2)"),
    "arccos": (lambda: F.acos(y() / 2), "acos(y / 2)"),
    "arctan": (lambda: F.atan(x()), "atan(x)"),
    "arctan2": (lambda: R.arctan2(x(), y()), "atan2(x, y)"),
    "sinh": (lambda: F.sinh(x()), "sinh(x)"),
    "cosh": (lambda: F.cosh(x()), "cosh(x)"),
    "tanh": (lambda: F.tanh(x()), "tanh(x)"),
    "arcsinh": (lambda: F.asinh(y()), "asinh(y)"),
    "arccosh": (lambda: F.acosh(F.abs(x()) + 1), "acosh(abs(x) + 1)"),
    "arctanh": (lambda: F.atanh(y() / 4), "atanh(y / 4)"),
    "degrees": (lambda: F.degrees(x()), "degrees(x)"),
    "radians": (lambda: F.radians(x()), "radians(x)"),
    "floor": (lambda: R.floor(x()), "floor(x)"),
    "ceil": (lambda: R.ceil(x()), "ceil(x)"),
    "trunc": (lambda: R.trunc(x()), "trunc(x)"),
    "rint": (lambda: R.rint(2 * y()), "round_even(2 * y, 0)"),
    "fix": (lambda: R.fix(y()), "trunc(y)"),
    "round": (lambda: R.round_(x(), 2), "round_even(x * 100, 0) / 100"),
    "sinc": (lambda: R.sinc(y()), "CASE WHEN y = 0 THEN 1.0 ELSE sin(pi() * y) / (pi() * y) END"),
    "i0": (lambda: R.i0(y()), "list_sum(list_transform(range(0, 40), lambda m: pow(y * y / 4, m) / (gamma(m + 1) * gamma(m + 1))))"),
    "nan_to_num": (lambda: R.nan_to_num(F.when(j() == 0, float("nan")).otherwise(x())), "CASE WHEN j = 0 THEN 0.0 ELSE x END"),
    "clip": (lambda: R.clip(x(), -1.0, 1.0), "least(greatest(x, -1.0), 1.0)"),
    "where": (lambda: F.when(R.greater(x(), y()), x()).otherwise(y()), "CASE WHEN x > y THEN x ELSE y END"),
    "select": (lambda: F.when(x() < -1, x() * 2).when(x() < 1, x() * x()).otherwise(0.0), "CASE WHEN x < -1 THEN x * 2 WHEN x < 1 THEN x * x ELSE 0.0 END"),
    "choose": (lambda: F.element_at(F.array(x(), y(), x() + y()), (F.pmod(j(), F.lit(3)) + 1).cast("int")), "[x, y, x + y][((j % 3 + 3) % 3 + 1)::INT]"),
    "interp": (lambda: R.interp(x(), [-2.0, -1.0, 0.5, 2.0], [0.0, 3.0, -1.0, 4.0]), "CASE WHEN x < -2 THEN 0.0 WHEN x >= 2 THEN 4.0 WHEN x < -1 THEN (x + 2) * 3 WHEN x < 0.5 THEN 3 - (x + 1) * 4 / 1.5 ELSE -1 + (x - 0.5) * 5 / 1.5 END"),
    "chebyshev": (lambda: polynomials.evaluate(y(), [1.0, -2.0, 0.5, 3.0]), "1 - 2 * y + 0.5 * (2 * y * y - 1) + 3 * (4 * y * y * y - 3 * y)"),
    "hermite": (lambda: polynomials.evaluate(y(), [1.0, -2.0, 0.5, 3.0], "hermite"), "1 - 4 * y + 0.5 * (4 * y * y - 2) + 3 * (8 * y * y * y - 12 * y)"),
    "laguerre": (lambda: polynomials.evaluate(y(), [1.0, -2.0, 0.5, 3.0], "laguerre"), "1 - 2 * (1 - y) + 0.5 * (y * y - 4 * y + 2) / 2 + 3 * (-y * y * y + 9 * y * y - 18 * y + 6) / 6"),
    "legendre": (lambda: polynomials.evaluate(y(), [1.0, -2.0, 0.5, 3.0], "legendre"), "1 - 2 * y + 0.5 * (3 * y * y - 1) / 2 + 3 * (5 * y * y * y - 3 * y) / 2"),
    "complex_abs": (lambda: C.absolute(C.make(x(), y())), "sqrt(x * x + y * y)"),
    "complex_angle": (lambda: C.angle(C.make(x(), y())), "atan2(y, x)"),
    "complex_multiply_re": (lambda: C.multiply(C.make(x(), y()), C.make(y(), x()))["re"], "x * y - y * x"),
    "complex_multiply_im": (lambda: C.multiply(C.make(x(), y()), C.make(y(), x()))["im"], "x * x + y * y"),
    "complex_divide_re": (lambda: C.divide(C.make(x(), y()), C.make(F.lit(3.0), y()))["re"], "(3 * x + y * y) / (9 + y * y)"),
    "complex_divide_im": (lambda: C.divide(C.make(x(), y()), C.make(F.lit(3.0), y()))["im"], "(3 * y - x * y) / (9 + y * y)"),
    "complex_exp_re": (lambda: C.exp(C.make(x(), y()))["re"], "exp(x) * cos(y)"),
    "complex_conjugate_im": (lambda: C.conjugate(C.make(x(), y()))["im"], "-y"),
    "emath_sqrt_re": (lambda: C.emath_sqrt(x())["re"], "CASE WHEN x >= 0 THEN sqrt(abs(x)) ELSE 0.0 END"),
    "emath_sqrt_im": (lambda: C.emath_sqrt(x())["im"], "CASE WHEN x >= 0 THEN 0.0 ELSE sqrt(abs(x)) END"),
    "emath_log_im": (lambda: C.emath_log(y() + 0.125)["im"], "CASE WHEN y + 0.125 < 0 THEN pi() ELSE 0.0 END"),
    "emath_log2_re": (lambda: C.emath_log2(y() + 0.125)["re"], "log2(abs(y + 0.125))"),
    "emath_logn_re": (lambda: C.emath_logn(3.0, y() + 0.125)["re"], "ln(abs(y + 0.125)) / ln(3.0)"),
    "emath_arctanh_re": (lambda: C.emath_arctanh(y() + 0.125)["re"], "0.5 * ln(abs((1.125 + y) / (0.875 - y)))"),
    "nextafter": (lambda: R.nextafter(x(), y()), "nextafter(x, y)"),
    "spacing": (lambda: R.spacing(F.abs(x()) + 1) * 1e15, "(nextafter(abs(x) + 1, 'inf'::DOUBLE) - (abs(x) + 1)) * 1e15"),
    "frexp_mantissa": (lambda: F.sqrt(R.frexp(F.abs(x()) + 0.1)["mantissa"]), "sqrt((abs(x) + 0.1) / pow(2.0, floor(log2(abs(x) + 0.1)) + 1))"),
    "polynomial": (lambda: polynomials.Polynomial([1.0, -2.0, 0.5, 3.0])(y()), "1 - 2 * y + 0.5 * y * y + 3 * y * y * y"),
    "emath_log10_re": (lambda: C.emath_log10(y() + 0.125)["re"], "log10(abs(y + 0.125))"),
    "emath_power_re": (lambda: C.emath_power(y(), F.lit(2.0))["re"], "y * y"),
    "emath_arcsin_re": (lambda: C.emath_arcsin(y())["re"], "CASE WHEN abs(y) <= 1 THEN asin(CASE WHEN abs(y) <= 1 THEN y ELSE 0 END) ELSE sign(y) * pi() / 2 END"),
    "emath_arccos_re": (lambda: C.emath_arccos(y())["re"], "CASE WHEN abs(y) <= 1 THEN acos(CASE WHEN abs(y) <= 1 THEN y ELSE 0 END) WHEN y > 0 THEN 0.0 ELSE pi() END"),
}
#: name: (column expression, SQL expression) of truth values and whole numbers
EXACT_FUNCTIONS = {
    "equal": (lambda: R.equal(y(), R.floor(y())), "y = floor(y)"),
    "not_equal": (lambda: R.not_equal(y(), R.floor(y())), "y <> floor(y)"),
    "less": (lambda: R.less(x(), y()), "x < y"),
    "less_equal": (lambda: R.less_equal(x(), y()), "x <= y"),
    "greater": (lambda: R.greater(x(), y()), "x > y"),
    "greater_equal": (lambda: R.greater_equal(x(), y()), "x >= y"),
    "logical_and": (lambda: R.logical_and(y(), j()), "y <> 0 AND j <> 0"),
    "logical_or": (lambda: R.logical_or(y(), j()), "y <> 0 OR j <> 0"),
    "logical_xor": (lambda: R.logical_xor(y(), j()), "(y <> 0) <> (j <> 0)"),
    "logical_not": (lambda: R.logical_not(y()), "y = 0"),
    "signbit": (lambda: R.signbit(x()), "x < 0"),
    "isnan": (lambda: F.isnan(R.divide(y(), y())), "y = 0"),
    "isinf": (lambda: R.isinf(R.divide(F.lit(1.0), y())), "y = 0"),
    "isfinite": (lambda: R.isfinite(R.divide(F.lit(1.0), y())), "y <> 0"),
    "isposinf": (lambda: R.isposinf(R.divide(x(), F.abs(y()))), "y = 0 AND x > 0"),
    "isneginf": (lambda: R.isneginf(R.divide(x(), F.abs(y()))), "y = 0 AND x < 0"),
    "isclose": (lambda: R.isclose(x(), y(), 0.1, 0.1), "abs(x - y) <= 0.1 + 0.1 * abs(y)"),
    "int_add": (lambda: R.int_add(i(), j()), "i + j"),
    "int_subtract": (lambda: R.int_subtract(i(), j()), "i - j"),
    "int_multiply": (lambda: R.int_multiply(i(), j()), "i * j"),
    "int_floor_divide": (lambda: R.int_floor_divide(i(), j()), "CASE WHEN j = 0 THEN 0 ELSE CAST(floor(i / j) AS BIGINT) END"),
    "int_remainder": (lambda: R.int_remainder(i(), j()), "CASE WHEN j = 0 THEN 0 ELSE i - j * CAST(floor(i / j) AS BIGINT) END"),
    "int_fmod": (lambda: R.int_fmod(i(), j()), "CASE WHEN j = 0 THEN 0 ELSE i % j END"),
    "int_power": (lambda: R.int_power(i(), 5), "i * i * i * i * i"),
    "gcd": (lambda: R.gcd(i(), j()), "CAST(gcd(i, j) AS BIGINT)"),
    "lcm": (lambda: R.lcm(i(), j()), "CAST(lcm(i, j) AS BIGINT)"),
    "bitwise_and": (lambda: i().bitwiseAND(j()), "i & j"),
    "bitwise_or": (lambda: i().bitwiseOR(j()), "i | j"),
    "bitwise_xor": (lambda: i().bitwiseXOR(j()), "xor(i, j)"),
    "invert": (lambda: F.bitwise_not(i()), "-i - 1"),
    "left_shift": (lambda: R.left_shift(F.abs(i()), F.abs(j())), "abs(i) << abs(j)"),
    "right_shift": (lambda: R.right_shift(F.abs(i()), F.abs(j())), "abs(i) >> abs(j)"),
    "bitwise_count": (lambda: R.bitwise_count(i()).cast("long"), "CAST(bit_count(abs(i)) AS BIGINT)"),
    "binary_repr": (lambda: R.binary_repr(i()), "CASE WHEN i < 0 THEN '-' ELSE '' END || bin(abs(i))"),
    "base_repr": (lambda: R.base_repr(i(), 16), "CASE WHEN i < 0 THEN '-' ELSE '' END || upper(to_hex(abs(i)))"),
    "digitize": (lambda: R.digitize(x(), [-2.0, -1.0, 0.0, 1.0]).cast("long"), "CAST((x >= -2)::INT + (x >= -1)::INT + (x >= 0)::INT + (x >= 1)::INT AS BIGINT)"),
    "complex_less": (lambda: C.less(C.make(y(), x()), C.make(j().cast("double"), x() / 2)), "y < j OR (y = j AND x < x / 2)"),
}


def _elementwise(name: str, column, sql: str, near: bool) -> None:
    @_query(f"ufunc_{name}", f"SELECT k, {f'round({sql}, 7) + 0.0' if near else sql} AS v FROM {_OPERANDS}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _operands(spark, sf_dir).select("k", column().alias("v"))
        return out.withColumn("v", _near(F.col("v"))) if near else out


#: Plain arithmetic, which both sides do bit by bit alike.
_PLAIN = {"nextafter", "add", "subtract", "multiply", "square", "ldexp", "select", "complex_multiply_re", "complex_multiply_im"}
for _name, (_column, _sql) in FLOAT_FUNCTIONS.items():
    _elementwise(_name, _column, _sql, _name not in _PLAIN)
for _name, (_column, _sql) in EXACT_FUNCTIONS.items():
    _elementwise(_name, _column, _sql, False)


# Reductions of the line items by return flag and line number


_NAN = "'nan'::DOUBLE"
_HOLED = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END"
#: name: (aggregate, SQL aggregate); p is the price, h the price with NaN at line number 3
REDUCTIONS = {
    "sum": (lambda: A.sum_("p"), "sum(p)"),
    "prod": (lambda: A.prod(F.col("l_discount") / 10000 + 1), "exp(sum(ln(l_discount / 10000 + 1)))"),
    "max": (lambda: A.max_("p"), "max(p)"),
    "min": (lambda: A.min_("p"), "min(p)"),
    "any": (lambda: A.any_(F.col("l_discount") > 0.09), "bool_or(l_discount > 0.09)"),
    "all": (lambda: A.all_(F.col("l_quantity")), "bool_and(l_quantity <> 0)"),
    "count_nonzero": (lambda: A.count_nonzero("l_discount"), "count(*) FILTER (l_discount <> 0)"),
    "ptp": (lambda: A.ptp("p"), "max(p) - min(p)"),
    "mean": (lambda: A.mean("p"), "avg(p)"),
    "var": (lambda: A.var("l_quantity"), "var_pop(l_quantity)"),
    "var_ddof_2": (lambda: A.var("l_quantity", 2), "var_pop(l_quantity) * count(*) / (count(*) - 2)"),
    "std": (lambda: A.std("l_quantity", 1), "stddev_samp(l_quantity)"),
    "median": (lambda: A.median("p"), "median(p)"),
    "average": (lambda: A.average("p", "l_quantity"), "sum(p * l_quantity) / sum(l_quantity)"),
    "nansum": (lambda: A.nansum("h"), "coalesce(sum(n), 0)"),
    "nanprod": (lambda: A.nanprod(F.col("h") * 0 + 1), "1.0"),
    "nanmean": (lambda: A.nanmean("h"), f"coalesce(avg(n), {_NAN})"),
    "nanvar": (lambda: A.nanvar(F.col("h") / 1000), f"coalesce(var_pop(n / 1000), {_NAN})"),
    "nanstd": (lambda: A.nanstd(F.col("h") / 1000), f"coalesce(stddev_pop(n / 1000), {_NAN})"),
    "nanmax": (lambda: A.nanmax("h"), f"coalesce(max(n), {_NAN})"),
    "nanmin": (lambda: A.nanmin("h"), f"coalesce(min(n), {_NAN})"),
    "nanmedian": (lambda: A.nanmedian("h"), f"coalesce(median(n), {_NAN})"),
    "nan_propagates_max": (lambda: A.max_("h"), f"CASE WHEN count(*) > count(n) THEN {_NAN} ELSE max(n) END"),
    "nan_propagates_min": (lambda: A.min_("h"), f"CASE WHEN count(*) > count(n) THEN {_NAN} ELSE min(n) END"),
    "cov": (lambda: A.cov("p", "l_quantity") / 1000, "covar_samp(p, l_quantity) / 1000"),
    "corrcoef": (lambda: A.corrcoef("p", "l_quantity"), "corr(p, l_quantity)"),
    "weighted_cov": (lambda: A.weighted_cov(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), "(sum(l_quantity * l_discount * l_tax) - sum(l_quantity * l_discount) * sum(l_quantity * l_tax) / sum(l_quantity)) / (sum(l_quantity) - 1)"),
    "norm_2": (lambda: A.vector_norm("l_quantity"), "sqrt(sum(l_quantity * l_quantity))"),
    "norm_1": (lambda: A.vector_norm("l_quantity", 1), "sum(abs(l_quantity))"),
    "norm_inf": (lambda: A.vector_norm("l_quantity", float("inf")), "max(abs(l_quantity))"),
    "norm_3": (lambda: A.vector_norm("l_quantity", 3), "pow(sum(pow(abs(l_quantity), 3)), 1.0 / 3)"),
}


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    p = F.col("l_extendedprice")
    return line.select("l_returnflag", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_orderkey", p.alias("p"), F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(p).alias("h"))


def _reduction(name: str, aggregate, sql: str) -> None:
    plain = name in ("any", "all", "count_nonzero")
    outer = sql if plain else f"round({sql}, 4)"

    @_query(f"reduce_{name}", f"SELECT l_returnflag, l_linenumber, {outer} AS v FROM (SELECT *, l_extendedprice AS p, {_HOLED} AS n FROM lineitem) GROUP BY l_returnflag, l_linenumber")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = aggregate()
        return _prices(spark, sf_dir).groupBy("l_returnflag", "l_linenumber").agg((v if plain else F.round(v, 4)).alias("v"))


for _name, (_aggregate, _sql) in REDUCTIONS.items():
    _reduction(_name, _aggregate, _sql)


@_query("reduce_argmax", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) AS first_largest FROM orders GROUP BY o_custkey")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.argmax("o_totalprice", "o_orderkey").alias("first_largest"))


@_query("reduce_argmin", "SELECT o_custkey, arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS first_least FROM orders GROUP BY o_custkey")
def argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.argmin("o_totalprice", "o_orderkey").alias("first_least"))


@_query("reduce_axis_pair", "SELECT l_returnflag, CAST(NULL AS INTEGER) AS l_linenumber, sum(l_quantity) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, l_linenumber, sum(l_quantity) FROM lineitem GROUP BY 2")
def reduce_axis_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over either of two axes from one pass: grouping sets."""
    line = _table(spark, sf_dir, "lineitem")
    return line.groupingSets([["l_returnflag"], ["l_linenumber"]], "l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("v"))


# Quantiles of prices by priority, all definitions

_QS = (0.1, 0.5, 0.77)


def _quantile_sql(method: str, q: float) -> str:
    plotting = {k: f"n * {q} + {a + q * (1 - a - b)!r} - 1" for k, (a, b) in quantiles.PLOTTING.items()}
    if method in plotting:
        at, share = plotting[method], "place - floor(place)"
    elif method in ("inverted_cdf", "averaged_inverted_cdf"):
        at, share = f"n * {q} - 1", f"CASE WHEN place = floor(place) THEN {0.0 if method == 'inverted_cdf' else 0.5} ELSE 1.0 END"
    elif method == "closest_observation":
        at, share = f"n * {q} - 1.5", "CASE WHEN place = floor(place) AND CAST(floor(place) AS BIGINT) % 2 = 1 THEN 0.0 ELSE 1.0 END"
    else:
        at = {"lower": f"floor((n - 1) * {q})", "higher": f"ceil((n - 1) * {q})", "nearest": f"round_even((n - 1) * {q}, 0)", "midpoint": f"(n - 1) * {q}"}[method]
        share = "CASE WHEN place = floor(place) THEN 0.0 ELSE 0.5 END" if method == "midpoint" else "0.0"
    return f"""SELECT o_orderpriority, CAST({q} AS DOUBLE) AS q, round(lo + (hi - lo) * share, 4) AS quantile FROM (
  SELECT o_orderpriority, {share} AS share, values[CAST(least(greatest(floor(place), 0), n - 1) AS BIGINT) + 1] AS lo, values[CAST(least(greatest(floor(place) + 1, 0), n - 1) AS BIGINT) + 1] AS hi
  FROM (SELECT *, CAST({at} AS DOUBLE) AS place FROM (SELECT o_orderpriority, list(o_totalprice ORDER BY o_totalprice) AS values, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)))"""


def _quantile(method: str) -> None:
    @_query(f"quantile_{method}", " UNION ALL ".join(_quantile_sql(method, q) for q in _QS))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = quantiles.quantiles(_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", list(_QS), method)
        return out.withColumn("quantile", F.round("quantile", 4))


for _name in quantiles.METHODS:
    _quantile(_name)


@_query("quantile_weighted", """WITH c AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS e, sum(w) OVER (PARTITION BY l_returnflag) AS a FROM c)
SELECT l_returnflag, CAST(q AS DOUBLE) AS q, min(v) FILTER (e / a >= q) AS quantile FROM r, (VALUES (0.25), (0.5)) x(q) GROUP BY 1, 2""")  # fmt: skip
def quantile_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.weighted_quantiles(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", [0.25, 0.5])


# Histograms

_EDGES = [0.0, 1e4, 5e4, 1e5, 2e5, 4e5, 6e5]


@_query("histogram_edges", f"SELECT CAST(b AS INTEGER) AS bin, {_EDGES}[b + 1] AS low, {_EDGES}[b + 2] AS high, (SELECT count(*) FROM orders WHERE o_totalprice >= {_EDGES}[b + 1] AND (o_totalprice < {_EDGES}[b + 2] OR (b = 5 AND o_totalprice = {_EDGES}[b + 2]))) AS count FROM range(6) t(b)")
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", _EDGES)


@_query("histogram_even", "WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CAST(least(floor((l_quantity - lo) * 7 / (hi - lo)), 6) AS INTEGER) AS bin, count(*) AS count FROM lineitem, r GROUP BY 1")
def histogram_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    edges = histograms.bin_edges(line, "l_quantity", 7)
    return line.groupBy(histograms.even_bin_of(F.col("l_quantity"), edges[0], edges[-1], 7).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


@_query("histogram_density", f"SELECT CAST(b AS INTEGER) AS bin, round(1e9 * (SELECT count(*) FROM orders WHERE o_totalprice >= {_EDGES}[b + 1] AND o_totalprice < {_EDGES}[b + 2]) / ({_EDGES}[b + 2] - {_EDGES}[b + 1]) / (SELECT count(*) FROM orders WHERE o_totalprice BETWEEN 0 AND 6e5), 4) AS density FROM range(6) t(b)")
def histogram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histograms.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", _EDGES, density=True)
    return out.select("bin", F.round(F.col("density") * 1e9, 4).alias("density"))


@_query("histogram_2d", "SELECT CAST(least(floor((l_quantity - 0) / 10), 4) AS INTEGER) AS bin_l_quantity, CAST(least(floor(l_tax / 0.04 + 1e-9), 1) AS INTEGER) AS bin_l_tax, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_tax BETWEEN 0 AND 0.08 GROUP BY 1, 2")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.histogramdd(_table(spark, sf_dir, "lineitem"), {"l_quantity": [0.0, 10.0, 20.0, 30.0, 40.0, 50.0], "l_tax": [0.0, 0.04, 0.08]})


@_query("bincount", "SELECT CAST(v AS BIGINT) AS value, (SELECT count(*) FROM part WHERE p_size = v) AS count FROM range((SELECT max(p_size) + 1 FROM part)) t(v)")
def bincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.bincount(_table(spark, sf_dir, "part"), "p_size")


@_query("bincount_weighted", "SELECT CAST(v AS BIGINT) AS value, round(coalesce((SELECT sum(p_retailprice) FROM part WHERE p_size = v), 0), 2) AS count FROM range((SELECT max(p_size) + 1 FROM part)) t(v)")
def bincount_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.bincount(_table(spark, sf_dir, "part"), "p_size", "p_retailprice").withColumn("count", F.round("count", 2))


# Lanes: events of each user by time

_W = "OVER (PARTITION BY user_id ORDER BY ts)"
_RUN = "OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _events(spark: SparkSession, sf_dir: str):
    return _table(spark, sf_dir, "events"), lanes.lane(["user_id"], ["ts"])


LANES = {
    "cumsum": (lambda w: F.round(lanes.cumsum(F.col("value"), w), 4), f"round(sum(value) {_RUN}, 4)"),
    "cumprod": (lambda w: F.round(lanes.cumprod(1 + F.col("value") / 1e5, w), 9), f"round(exp(sum(ln(1 + value / 1e5)) {_RUN}), 9)"),
    "nancumprod": (lambda w: F.round(lanes.nancumprod(F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(1 + F.col("value") / 1e5), w), 9), f"round(exp(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE ln(1 + value / 1e5) END) {_RUN}), 9)"),
    "nancumsum": (lambda w: F.round(lanes.nancumsum(F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")), w), 4), f"round(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END) {_RUN}, 4)"),
    "maximum_accumulate": (lambda w: lanes.cummax(F.col("value"), w), f"max(value) {_RUN}"),
    "minimum_accumulate": (lambda w: lanes.cummin(F.col("value"), w), f"min(value) {_RUN}"),
    "diff": (lambda w: F.round(lanes.diff(F.col("value"), w), 4), f"round(value - lag(value) {_W}, 4)"),
    "diff_2": (lambda w: F.round(lanes.diff(F.col("value"), w, 2), 4), f"round(value - 2 * lag(value) {_W} + lag(value, 2) {_W}, 4)"),
    "gradient": (lambda w: F.round(lanes.gradient(F.col("value"), w), 4), f"round(CASE WHEN lag(value) {_W} IS NULL THEN lead(value) {_W} - value WHEN lead(value) {_W} IS NULL THEN value - lag(value) {_W} ELSE (lead(value) {_W} - lag(value) {_W}) / 2 END, 4)"),
    "convolve": (lambda w: F.round(lanes.convolve(F.col("value"), [0.5, 0.25, 0.25], w), 4), f"round(0.5 * value + 0.25 * coalesce(lag(value) {_W}, 0) + 0.25 * coalesce(lag(value, 2) {_W}, 0), 4)"),
}


def _lane(name: str, column, sql: str) -> None:
    @_query(f"lane_{name}", f"SELECT event_id, {sql} AS v FROM events")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, w = _events(spark, sf_dir)
        return events.select("event_id", column(w).alias("v"))


for _name, (_column, _sql) in LANES.items():
    _lane(_name, _column, _sql)


@_query("lane_trapezoid", f"SELECT user_id, round(coalesce(sum((t - pt) * (value + pv) / 2), 0), 3) AS integral FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS pt, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS pv FROM (SELECT *, epoch_us(ts) / 3.6e9 AS t FROM events)) GROUP BY user_id")
def lane_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    out = lanes.trapezoid(_table(spark, sf_dir, "events").withColumn("t", hours), ["user_id"], "t", "value")
    return out.withColumn("integral", F.round("integral", 3))


@_query("scan_whole_axis", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS running FROM orders")
def scan_whole_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum over all orders: by blocks, as no key divides it."""
    orders = numbered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    vector = creation.of_column(orders, "o_totalprice", "pos")
    running = vector.scan(F.sum, lambda a, b: a + b, 0)
    return orders.join(running.df, orders["pos"] == running.df["i0"]).select("o_orderkey", F.round("v", 2).alias("running"))


# Sorting, searching, sets


@_query("sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.argsort(_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@_query("sort_descending", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders")
def sort_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sort(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", True, [F.col("o_orderkey")]).select("o_orderkey", "pos")


@_query("lexsort", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) - 1 AS pos FROM part")
def lexsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.lexsort(_table(spark, sf_dir, "part"), ["p_size", "p_brand"], "p_partkey")


@_query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.top(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ties=[F.col("o_orderkey")])


for _right, _op in ((False, "<"), (True, "<=")):

    _keys = "SELECT DISTINCT l_quantity * 1000 AS key FROM lineitem"
    _places = f"SELECT key, (SELECT count(*) FROM orders WHERE o_totalprice {_op} key) AS place FROM ({_keys})"

    @_query(f"searchsorted_{'right' if _right else 'left'}", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, key, place FROM lineitem JOIN ({_places}) ON key = l_quantity * 1000")
    def searchsorted(spark: SparkSession, sf_dir: str, right: bool = _right) -> DataFrame:
        keys = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") * 1000).alias("key"))
        return sets.searchsorted(_table(spark, sf_dir, "orders"), "o_totalprice", keys, "key", right)


@_query("unique_counts", "SELECT p_brand AS value, count(*) AS count, min(p_partkey) AS first_index FROM part GROUP BY p_brand")
def unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.unique(_table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@_query("unique_inverse", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) - 1 AS inverse FROM part")
def unique_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return sets.unique_inverse(part, "p_size", "p_partkey")


@_query("isin", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS member FROM customer")
def isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.isin(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", _table(spark, sf_dir, "orders"), "o_custkey")


_SETS = {"intersect1d": "INTERSECT", "union1d": "UNION", "setdiff1d": "EXCEPT"}
for _name, _op in {**_SETS, "setxor1d": ""}.items():
    _a, _b = "SELECT c_custkey AS value FROM customer", "SELECT l_suppkey * 7 AS value FROM lineitem"

    @_query(_name, f"{_a} {_op} {_b}" if _op else f"({_a} EXCEPT {_b}) UNION ALL ({_b} EXCEPT {_a})")
    def set_operation(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        other = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7).alias("s"))
        return getattr(sets, name)(_table(spark, sf_dir, "customer"), "c_custkey", other, "s")


# Selection and scatter


@_query("nonzero", "SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS pos, l_orderkey, l_extendedprice FROM lineitem WHERE l_discount = 0")
def nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression by a mask: what stays is numbered anew."""
    line = _table(spark, sf_dir, "lineitem").filter("l_discount = 0")
    return numbered(line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]).select("pos", "l_orderkey", "l_extendedprice")


@_query("take", "SELECT n_nationkey, r_name AS taken FROM nation JOIN region ON r_regionkey = n_regionkey")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gather: nations take the names of their regions."""
    return _table(spark, sf_dir, "nation").join(small_side(_table(spark, sf_dir, "region"), size=F.octet_length("r_name")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("taken"))


@_query("add_at", "SELECT c_custkey, round(c_acctbal + coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0), 2) AS balance FROM customer")
def add_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scatter with repeated places: orders are added to their customers' balances."""
    added = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("more"))
    c = _table(spark, sf_dir, "customer")
    return c.join(added, c["c_custkey"] == added["o_custkey"], "left").select("c_custkey", F.round(F.col("c_acctbal") + F.coalesce("more", F.lit(0.0)), 2).alias("balance"))


@_query("reduceat", "SELECT o_orderkey // 1000 AS segment, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def reduceat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("segment")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


# Arrays: embeddings as a matrix

_M = "(SELECT vec_id AS r, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings)"


def _matrix(spark: SparkSession, sf_dir: str) -> NDFrame:
    return creation.of_arrays(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 64)


def _rows(x: NDFrame, digits: int = 5) -> DataFrame:
    return x.df.withColumn("v", F.round(F.col("v").cast("double"), digits) + 0.0)


@_query("gram", f"SELECT a.c AS i0, b.c AS i1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(contractions.gram(_table(spark, sf_dir, "embeddings"), "embedding", 64), 3)


@_query("einsum_gram", f"SELECT a.c AS i0, b.c AS i1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2")
def einsum_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return _rows(einsum("ri,rj->ij", m, m), 3)


@_query("matvec", f"SELECT r AS i0, round(sum(v * (c + 1)), 4) + 0.0 AS v FROM {_M} GROUP BY 1")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(contractions.matvec(_matrix(spark, sf_dir), creation.arange(spark, 1.0, 65.0)), 4)


@_query("vecdot", "SELECT vec_id AS i0, round(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)), 5) + 0.0 AS v FROM embeddings")
def vecdot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return _rows(contractions.vecdot(m, m))


@_query("matmul_blocked", f"SELECT a.c AS i0, b.c AS i1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2")
def matmul_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return _rows(contractions.blocked_matmul(m.T, m, 128), 3)


@_query("outer", "SELECT CAST(a.n_nationkey AS BIGINT) AS i0, CAST(b.n_nationkey AS BIGINT) AS i1, CAST(a.n_regionkey * (b.n_regionkey + 1) AS BIGINT) AS v FROM nation a, nation b")
def outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").withColumn("r", F.col("n_regionkey").cast("long"))
    a = creation.of_column(n, "r", "n_nationkey", 25)
    return contractions.outer(a, a + 1).df


@_query("kron", "SELECT CAST(a.n_nationkey * 25 + b.n_nationkey AS BIGINT) AS i0, CAST(a.n_regionkey * b.n_regionkey AS BIGINT) AS v FROM nation a, nation b")
def kron(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").withColumn("r", F.col("n_regionkey").cast("long"))
    a = creation.of_column(n, "r", "n_nationkey", 25)
    return contractions.kron(a, a).df


@_query("trace", "SELECT CAST(sum(embedding[vec_id + 1]::DOUBLE) AS DOUBLE) AS v FROM embeddings WHERE vec_id < 64")
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contractions.trace(_matrix(spark, sf_dir)).df


_SHAPES = {
    "transpose": (lambda m: m.T, f"SELECT c AS i0, r AS i1, v FROM {_M}"),
    "reshape": (lambda m: m.reshape(m.shape[0], 8, 8), f"SELECT r AS i0, c // 8 AS i1, c % 8 AS i2, v FROM {_M}"),
    "ravel": (lambda m: m.ravel(), f"SELECT r * 64 + c AS i0, v FROM {_M}"),
    "flip": (lambda m: m.flip(1), f"SELECT r AS i0, 63 - c AS i1, v FROM {_M}"),
    "roll": (lambda m: m.roll(5, 1), f"SELECT r AS i0, (c + 5) % 64 AS i1, v FROM {_M}"),
    "rot90": (lambda m: m.rot90(), f"SELECT 63 - c AS i0, r AS i1, v FROM {_M}"),
    "repeat": (lambda m: m.repeat(2, 1), f"SELECT r AS i0, c * 2 + k AS i1, v FROM {_M}, range(2) t(k)"),
    "tile": (lambda m: m.tile((1, 3)), f"SELECT r AS i0, c + k * 64 AS i1, v FROM {_M}, range(3) t(k)"),
    "slice_step": (lambda m: m[1::3, ::-2], f"SELECT (r - 1) // 3 AS i0, (63 - c) // 2 AS i1, v FROM {_M} WHERE (r - 1) % 3 = 0 AND c % 2 = 1"),
    "take_places": (lambda m: m[:, [5, 0, 5]], f"SELECT r AS i0, CAST(k AS BIGINT) AS i1, v FROM {_M} JOIN (VALUES (0, 5), (1, 0), (2, 5)) t(k, p) ON p = c"),
    "boolean_mask": (lambda m: m[m > 0.15], f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i0, v FROM {_M} WHERE v > 0.15"),
    "tril": (lambda m: m.triangle(True), f"SELECT r AS i0, c AS i1, CASE WHEN c <= r THEN v ELSE 0 END AS v FROM {_M}"),
    "triu": (lambda m: m.triangle(False, 1), f"SELECT r AS i0, c AS i1, CASE WHEN c - r >= 1 THEN v ELSE 0 END AS v FROM {_M}"),
    "diagonal": (lambda m: m.diagonal(2), f"SELECT r AS i0, v FROM {_M} WHERE c - r = 2"),
    "concatenate": (lambda m: joining.concatenate([m[:, :2], m[:, 62:]], 1), f"SELECT r AS i0, CASE WHEN c < 2 THEN c ELSE c - 60 END AS i1, v FROM {_M} WHERE c < 2 OR c >= 62"),
    "stack": (lambda m: joining.stack([m, m * 2]), f"SELECT CAST(k AS BIGINT) AS i0, r AS i1, c AS i2, v * (k + 1) AS v FROM {_M}, range(2) t(k)"),
    "delete": (lambda m: joining.delete(m, [1, 3], 1), f"SELECT r AS i0, c - (c > 1)::INT - (c > 3)::INT AS i1, v FROM {_M} WHERE c NOT IN (1, 3)"),
    "insert": (lambda m: joining.insert(m, [1], [9.0], 1), f"SELECT r AS i0, c + (c >= 1)::INT AS i1, v FROM {_M} UNION ALL SELECT DISTINCT r, 1, 9.0 FROM {_M}"),
    "pad_constant": (lambda m: joining.pad(m, [(0, 0), (1, 2)], value=7), f"SELECT r AS i0, c + 1 AS i1, v FROM {_M} UNION ALL SELECT DISTINCT r, k, 7.0 FROM {_M}, (VALUES (0), (65), (66)) t(k)"),
    "pad_reflect": (lambda m: joining.pad(m, [(0, 0), (2, 0)], "reflect"), f"SELECT r AS i0, c + 2 AS i1, v FROM {_M} UNION ALL SELECT r, 2 - c, v FROM {_M} WHERE c IN (1, 2)"),
    "broadcast_subtract": (lambda m: m - m.reduce(F.avg, axis=0), f"SELECT r AS i0, c AS i1, v - avg(v) OVER (PARTITION BY c) AS v FROM {_M}"),
    "sum_axis0": (lambda m: m.reduce(F.sum, axis=0), f"SELECT c AS i0, sum(v) AS v FROM {_M} GROUP BY c"),
    "max_axis1": (lambda m: m.reduce(F.max, axis=1), f"SELECT r AS i0, max(v) AS v FROM {_M} GROUP BY r"),
    "cumsum_axis1": (lambda m: m.scan(F.sum, lambda a, b: a + b, 1), f"SELECT r AS i0, c AS i1, sum(v) OVER (PARTITION BY r ORDER BY c) AS v FROM {_M}"),
    "fftshift": (lambda m: stacks.fftshift(m, 1), f"SELECT r AS i0, (c + 32) % 64 AS i1, v FROM {_M}"),
}


def _shape(name: str, f, sql: str) -> None:
    columns = sql.count("AS i2")
    names = "i0, i1, i2, " if columns else "i0, i1, " if " AS i1" in sql else "i0, "

    @_query(f"array_{name}", f"SELECT {names}round(v, 5) + 0.0 AS v FROM ({sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(f(_matrix(spark, sf_dir)))


for _name, (_f, _sql) in _SHAPES.items():
    _shape(_name, _f, _sql)


_DFT = f"SELECT r, CAST(k AS BIGINT) AS k, sum(v * cos(2 * pi() * k * c / 64)) AS re, -sum(v * sin(2 * pi() * k * c / 64)) AS im FROM {_M}, range(64) t(k) GROUP BY 1, 2"


@_query("fft", f"SELECT r AS i0, k AS i1, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM ({_DFT})")
def fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stacks.fft(_matrix(spark, sf_dir))
    return out.df.select("i0", "i1", (F.round(F.col("v")["re"], 4) + 0.0).alias("re"), (F.round(F.col("v")["im"], 4) + 0.0).alias("im"))


@_query("rfft", f"SELECT r AS i0, k AS i1, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM ({_DFT}) WHERE k <= 32")
def rfft(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stacks.rfft(_matrix(spark, sf_dir))
    return out.df.select("i0", "i1", (F.round(F.col("v")["re"], 4) + 0.0).alias("re"), (F.round(F.col("v")["im"], 4) + 0.0).alias("im"))


@_query("irfft_round_trip", f"SELECT r AS i0, c AS i1, round(v, 5) + 0.0 AS v FROM {_M}")
def irfft_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(stacks.irfft(stacks.rfft(_matrix(spark, sf_dir))))


# Stacks of 2 x 2 matrices [[4 + a, b], [b, 3 + a]], a = |e[2k]|, b = e[2k + 1], of all pairs of every embedding


def _pairs(spark: SparkSession, sf_dir: str) -> NDFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("embedding", 2 * k).alias("a"), F.get("embedding", 2 * k + 1).alias("b")))).alias("k", "e"))
    e = e.select((F.col("vec_id") * 32 + F.col("k")).alias("i0"), F.abs(F.col("e.a").cast("double")).alias("a"), F.col("e.b").cast("double").alias("b"))
    cells = F.inline(F.array(*(F.struct(F.lit(r).cast("long").alias("i1"), F.lit(c).cast("long").alias("i2"), v.alias("v")) for r, c, v in ((0, 0, 4 + F.col("a")), (0, 1, F.col("b")), (1, 0, F.col("b")), (1, 1, 3 + F.col("a"))))))
    return NDFrame(e.select("i0", cells), [e.count(), 2, 2])


_P = "(SELECT vec_id * 32 + k AS i0, 4 + abs(embedding[2 * k + 1]::DOUBLE) AS p, embedding[2 * k + 2]::DOUBLE AS q, 3 + abs(embedding[2 * k + 1]::DOUBLE) AS s FROM embeddings, range(32) t(k))"
_MEAN, _HALF = "(p + s) / 2", "sqrt((p - s) * (p - s) / 4 + q * q)"
LINEAR = {
    "det": (lambda m: stacks.det(m), f"SELECT i0, p * s - q * q AS v FROM {_P}"),
    "inv": (lambda m: stacks.inv(m)[:, 0, 0], f"SELECT i0, s / (p * s - q * q) AS v FROM {_P}"),
    "eigvalsh": (lambda m: stacks.eigvalsh(m), f"SELECT i0, CAST(k AS BIGINT) AS i1, {_MEAN} + (2 * k - 1) * {_HALF} AS v FROM {_P}, range(2) t(k)"),
    "svdvals": (lambda m: stacks.svdvals(m), f"SELECT i0, CAST(k AS BIGINT) AS i1, {_MEAN} + (1 - 2 * k) * {_HALF} AS v FROM {_P}, range(2) t(k)"),
    "cholesky": (lambda m: stacks.cholesky(m)[:, 1, 1], f"SELECT i0, sqrt(s - q * q / p) AS v FROM {_P}"),
    "matrix_power": (lambda m: stacks.matrix_power(m, 2)[:, 0, 1], f"SELECT i0, p * q + q * s AS v FROM {_P}"),
    "matrix_rank": (lambda m: stacks.matrix_rank(m), f"SELECT i0, 2.0 AS v FROM {_P}"),
    "matrix_norm": (lambda m: stacks.matrix_norm(m), f"SELECT i0, sqrt(p * p + 2 * q * q + s * s) AS v FROM {_P}"),
    "cond": (lambda m: stacks.cond(m), f"SELECT i0, ({_MEAN} + {_HALF}) / ({_MEAN} - {_HALF}) AS v FROM {_P}"),
    "solve": (lambda m: stacks.solve(m, m[:, :, 0]), f"SELECT i0, CAST(k AS BIGINT) AS i1, 1.0 - k AS v FROM {_P}, range(2) t(k)"),
    "slogdet": (lambda m: stacks.slogdet(m)[1], f"SELECT i0, ln(p * s - q * q) AS v FROM {_P}"),
    "pinv": (lambda m: stacks.pinv(m)[:, 1, 1], f"SELECT i0, p / (p * s - q * q) AS v FROM {_P}"),
}


def _linear(name: str, f, sql: str) -> None:
    names = "i0, i1, " if " AS i1" in sql else "i0, "

    @_query(f"linalg_{name}", f"SELECT {names}round(v, 5) + 0.0 AS v FROM ({sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(f(_pairs(spark, sf_dir)))


for _name, (_f, _sql) in LINEAR.items():
    _linear(_name, _f, _sql)


@_query("linalg_lstsq", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def lstsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = stacks.lstsq(_table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(fit["l_quantity"], fit["intercept"])], "slope double, intercept double").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


# Creation: arrays of as many places as there are suppliers

_S = "(SELECT count(*) FROM supplier)"


def _suppliers(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "supplier").count()


_COS = f"cos(pi() * (2 * k - ({_S} - 1)) / ({_S} - 1))"
CREATION = {
    "arange": (lambda s, n: creation.arange(s, 3, 3 + 4 * n, 4), f"SELECT CAST(k AS BIGINT) AS i0, CAST(3 + 4 * k AS BIGINT) AS v FROM range({_S}) t(k)"),
    "linspace": (lambda s, n: creation.linspace(s, -1.0, 2.0, n), f"SELECT CAST(k AS BIGINT) AS i0, -1.0 + k * 3.0 / ({_S} - 1) AS v FROM range({_S}) t(k)"),
    "logspace": (lambda s, n: creation.logspace(s, 0.0, 2.0, n), f"SELECT CAST(k AS BIGINT) AS i0, pow(10.0, k * 2.0 / ({_S} - 1)) AS v FROM range({_S}) t(k)"),
    "geomspace": (lambda s, n: creation.geomspace(s, 1.0, 256.0, n), f"SELECT CAST(k AS BIGINT) AS i0, pow(256.0, k * 1.0 / ({_S} - 1)) AS v FROM range({_S}) t(k)"),
    "eye": (lambda s, n: creation.eye(s, n, n + 1, 1), f"SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, CASE WHEN b - a = 1 THEN 1.0 ELSE 0.0 END AS v FROM range({_S}) t(a), range({_S} + 1) u(b)"),
    "tri": (lambda s, n: creation.tri(s, n), f"SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, CASE WHEN b <= a THEN 1.0 ELSE 0.0 END AS v FROM range({_S}) t(a), range({_S}) u(b)"),
    "vander": (lambda s, n: creation.vander(creation.arange(s, 1.0, n + 1.0), 3), f"SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, pow(a + 1.0, 2 - b) AS v FROM range({_S}) t(a), range(3) u(b)"),
    "meshgrid": (lambda s, n: creation.meshgrid(creation.arange(s, n), creation.arange(s, 2))[0], f"SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, CAST(b AS BIGINT) AS v FROM range(2) t(a), range({_S}) u(b)"),
    "hanning": (lambda s, n: creation.hanning(s, n), f"SELECT CAST(k AS BIGINT) AS i0, 0.5 + 0.5 * {_COS} AS v FROM range({_S}) t(k)"),
    "hamming": (lambda s, n: creation.hamming(s, n), f"SELECT CAST(k AS BIGINT) AS i0, 0.54 + 0.46 * {_COS} AS v FROM range({_S}) t(k)"),
    "blackman": (lambda s, n: creation.blackman(s, n), f"SELECT CAST(k AS BIGINT) AS i0, 0.42 + 0.5 * {_COS} + 0.08 * cos(2 * pi() * (2 * k - ({_S} - 1)) / ({_S} - 1)) AS v FROM range({_S}) t(k)"),
    "bartlett": (lambda s, n: creation.bartlett(s, n), f"SELECT CAST(k AS BIGINT) AS i0, 1 - abs(2.0 * k - ({_S} - 1)) / ({_S} - 1) AS v FROM range({_S}) t(k)"),
    "fftfreq": (lambda s, n: creation.fftfreq(s, n), f"SELECT CAST(k AS BIGINT) AS i0, (CASE WHEN k < ({_S} + 1) // 2 THEN k ELSE k - {_S} END) * 1.0 / {_S} AS v FROM range({_S}) t(k)"),
}


def _created(name: str, f, sql: str) -> None:
    whole = name in ("arange", "meshgrid")
    names = "i0, i1, " if " AS i1" in sql else "i0, "

    @_query(f"create_{name}", f"SELECT {names}{'v' if whole else 'CAST(round(v, 6) + 0.0 AS DOUBLE)'} AS v FROM ({sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, _suppliers(spark, sf_dir))
        return out.df if whole else _rows(out, 6)


for _name, (_f, _sql) in CREATION.items():
    _created(_name, _f, _sql)


# Random: whether the moments of as many draws as there are line items are where they belong

_DRAWS = {
    "uniform": (lambda g, n: g.uniform(2.0, 4.0, n), 3.0, 1 / 3),
    "integers": (lambda g, n: g.integers(0, 10, n), 4.5, 8.25),
    "normal": (lambda g, n: g.normal(1.0, 2.0, n), 1.0, 4.0),
    "exponential": (lambda g, n: g.exponential(2.0, n), 2.0, 4.0),
    "gumbel": (lambda g, n: g.gumbel(0.0, 1.0, n), 0.5772156649, math.pi**2 / 6),
    "laplace": (lambda g, n: g.laplace(0.0, 1.0, n), 0.0, 2.0),
    "logistic": (lambda g, n: g.logistic(0.0, 1.0, n), 0.0, math.pi**2 / 3),
    "rayleigh": (lambda g, n: g.rayleigh(1.0, n), math.sqrt(math.pi / 2), 2 - math.pi / 2),
    "weibull": (lambda g, n: g.weibull(2.0, n), math.gamma(1.5), math.gamma(2) - math.gamma(1.5) ** 2),
    "triangular": (lambda g, n: g.triangular(0.0, 1.0, 2.0, n), 1.0, 1 / 6),
    "geometric": (lambda g, n: g.geometric(0.25, n), 4.0, 12.0),
    "power": (lambda g, n: g.power(3.0, n), 0.75, 3 / 80),
    "gamma": (lambda g, n: g.gamma(3.0, 2.0, n), 6.0, 12.0),
    "beta": (lambda g, n: g.beta(2.0, 3.0, n), 0.4, 0.04),
    "binomial": (lambda g, n: g.binomial(10, 0.3, n), 3.0, 2.1),
    "poisson": (lambda g, n: g.poisson(4.0, n), 4.0, 4.0),
    "hypergeometric": (lambda g, n: g.hypergeometric(10, 10, 5, n), 2.5, 1.25 * 15 / 19),
    "random": (lambda g, n: g.random(n), 0.5, 1 / 12),
    "standard_normal": (lambda g, n: g.standard_normal(n), 0.0, 1.0),
    "standard_exponential": (lambda g, n: g.standard_exponential(n), 1.0, 1.0),
    "lognormal": (lambda g, n: g.lognormal(0.0, 0.5, n), math.exp(0.125), (math.exp(0.25) - 1) * math.exp(0.25)),
    "pareto": (lambda g, n: g.pareto(8.0, n), 1 / 7, 8 / (49 * 6)),
    "spawn": (lambda g, n: g.spawn(3)[2].random(n), 0.5, 1 / 12),
    "small_gamma": (lambda g, n: g.standard_gamma(0.5, n), 0.5, 0.5),
    "chisquare": (lambda g, n: g.chisquare(5.0, n), 5.0, 10.0),
    "noncentral_chisquare": (lambda g, n: g.noncentral_chisquare(4.0, 2.0, n), 6.0, 16.0),
    "f": (lambda g, n: g.f(5.0, 20.0, n), 20 / 18, 2 * 400 * 23 / (5 * 18**2 * 16)),
    "noncentral_f": (lambda g, n: g.noncentral_f(5.0, 20.0, 1.0, n), 20 * 6 / (5 * 18), 2 * (36 + 7 * 18) / (18**2 * 16) * 16),
    "standard_t": (lambda g, n: g.standard_t(12.0, n), 0.0, 1.2),
    "wald": (lambda g, n: g.wald(2.0, 6.0, n), 2.0, 8 / 6),
    "vonmises": (lambda g, n: g.vonmises(0.0, 4.0, n), 0.0, 0.2944),
    "zipf": (lambda g, n: g.zipf(6.0, n), 1.0369277551433699 / 1.0173430619844491, 1.0823232337111382 / 1.0173430619844491 - (1.0369277551433699 / 1.0173430619844491) ** 2),
    "negative_binomial": (lambda g, n: g.negative_binomial(4.0, 0.4, n), 6.0, 15.0),
    "logseries": (lambda g, n: g.logseries(0.6, n), -0.6 / (0.4 * math.log(0.4)), -0.6 * (0.6 + math.log(0.4)) / (0.16 * math.log(0.4) ** 2)),
    "dirichlet": (lambda g, n: g.dirichlet([2.0, 3.0, 5.0], n)[:, 0], 0.2, 0.16 / 11),
    "multivariate_normal": (lambda g, n: g.multivariate_normal([1.0, -1.0], [[2.0, 0.5], [0.5, 1.0]], n)[:, 1], -1.0, 1.0),
    "multinomial": (lambda g, n: g.multinomial(10, [0.2, 0.3, 0.5], n)[:, 2], 5.0, 2.5),
    "large_poisson": (lambda g, n: g.poisson(40_000.0, n), 40_000.0, 40_000.0),
}


def _drawn(name: str, f, mean: float, var: float) -> None:
    @_query(f"random_{name}", "SELECT count(*) AS n, true AS mean_near, true AS var_near FROM lineitem")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = _table(spark, sf_dir, "lineitem").count()
        out = f(default_rng(spark, 12345), n).df
        return out.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("v") - mean) < 6 * math.sqrt(var / n)).alias("mean_near"), (F.abs(F.var_pop("v") - var) < 0.15 * var).alias("var_near"))


for _name, _row in _DRAWS.items():
    _drawn(_name, *_row)


@_query("rolling_window", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.rolling import tumbling

    out = tumbling(_table(spark, sf_dir, "events"), "ts", "value", ["event_type"], "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"), "low", "high")



from . import index_queries, whole_queries  # noqa: E402, F401  they register their queries
