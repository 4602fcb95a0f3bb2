"""Aggregate expressions with array semantics, for use with any ``groupBy``.

All are built-in aggregates with partial aggregation, so they combine before
the shuffle.  Aggregates of no rows give the identity, or NaN where there is
none, never NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import real as R

NAN = float("nan")


def _v(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")), x)


def sum_(x) -> Column:
    return F.coalesce(F.sum(_v(x)), F.lit(0))


def prod(x) -> Column:
    return F.coalesce(F.product(_v(x).cast("double")), F.lit(1.0))


def max_(x) -> Column:
    return F.max(_v(x))  # NaN is the largest


def min_(x) -> Column:
    x = _v(x)
    return F.when(F.bool_or(F.isnan(x.cast("double"))), NAN).otherwise(F.min(x))


def ptp(x) -> Column:
    return max_(x) - min_(x)


def any_(x) -> Column:
    return F.coalesce(F.bool_or(R.truth(_v(x))), F.lit(False))


def all_(x) -> Column:
    return F.coalesce(F.bool_and(R.truth(_v(x))), F.lit(True))


def count_nonzero(x) -> Column:
    return F.count_if(R.truth(_v(x)))


def mean(x) -> Column:
    return F.coalesce(F.avg(_v(x).cast("double")), F.lit(NAN))


def var(x, ddof: float = 0) -> Column:
    x = _v(x).cast("double")
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.when(n > ddof, n - ddof)).otherwise(NAN)


def std(x, ddof: float = 0) -> Column:
    return F.sqrt(var(x, ddof))


def median(x) -> Column:
    x = _v(x).cast("double")
    return F.when(F.coalesce(F.bool_or(F.isnan(x)), F.lit(True)), NAN).otherwise(F.median(x))


def average(x, weights) -> Column:
    x, w = _v(x).cast("double"), _v(weights).cast("double")
    return R.divide(F.sum(x * w), F.sum(w))


def nansum(x) -> Column:
    return F.coalesce(F.sum(F.nanvl(_v(x).cast("double"), F.lit(0.0))), F.lit(0.0))


def nanprod(x) -> Column:
    return F.coalesce(F.product(F.nanvl(_v(x).cast("double"), F.lit(1.0))), F.lit(1.0))


def nanmean(x) -> Column:
    return mean(_known(_v(x)))


def nanvar(x, ddof: float = 0) -> Column:
    return var(_known(_v(x)), ddof)


def nanstd(x, ddof: float = 0) -> Column:
    return F.sqrt(nanvar(x, ddof))


def nanmax(x) -> Column:
    return F.coalesce(F.max(_known(_v(x))), F.lit(NAN))


def nanmin(x) -> Column:
    return F.coalesce(F.min(_known(_v(x))), F.lit(NAN))


def nanmedian(x) -> Column:
    return F.coalesce(F.median(_known(_v(x).cast("double"))), F.lit(NAN))


def argmax(x, index) -> Column:
    """The first index of the largest value; NaN is the largest."""
    return F.max(F.struct(_v(x).alias("v"), (-_v(index)).alias("i")))["i"] * -1


def argmin(x, index) -> Column:
    """The first index of the least value; NaN comes before all."""
    x = _v(x).cast("double")
    return F.min(F.struct((~F.isnan(x)).alias("n"), x.alias("v"), _v(index).alias("i")))["i"]


def nanargmax(x, index) -> Column:
    x = _v(x)
    return F.max(F.when(~F.isnan(x.cast("double")), F.struct(x.alias("v"), (-_v(index)).alias("i"))))["i"] * -1


def nanargmin(x, index) -> Column:
    x = _v(x)
    return F.min(F.when(~F.isnan(x.cast("double")), F.struct(x.alias("v"), _v(index).alias("i"))))["i"]


def cov(x, y, ddof: float = 1) -> Column:
    n = F.count(_v(x))
    return F.when(n > ddof, F.covar_pop(_v(x), _v(y)) * n / F.when(n > ddof, n - ddof)).otherwise(NAN)


def corrcoef(x, y) -> Column:
    r = R.divide(F.covar_pop(_v(x), _v(y)), F.stddev_pop(_v(x)) * F.stddev_pop(_v(y)))
    return R.clip(r, -1.0, 1.0)


def weighted_cov(x, y, weights, ddof: float = 1) -> Column:
    """Covariance with frequency weights."""
    x, y, w = _v(x), _v(y), _v(weights)
    total = F.sum(w)
    cross = F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / total
    return R.divide(cross, total - ddof)


def vector_norm(x, order: float = 2) -> Column:
    x = F.abs(_v(x).cast("double"))
    if order == 2:
        return F.sqrt(F.sum(x * x))
    if order == 1:
        return F.sum(x)
    if order == float("inf"):
        return F.max(x)
    if order == float("-inf"):
        return F.min(x)
    if order == 0:
        return F.count_if(x != 0).cast("double")
    return F.pow(F.sum(F.pow(x, F.lit(float(order)))), F.lit(1.0 / order))
