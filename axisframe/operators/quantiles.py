"""Quantiles of groups by all thirteen definitions, with ranks in place of collected groups.

Each definition gives a place between two order statistics.  The built-in
percentile aggregates keep a group's distinct values with their counts; where
a definition needs other places than theirs, values are counted, running
counts rank them, and only the values around the asked places are kept, so a
group never has to fit in memory.  Running counts are taken within ranges of
(group, value), to which the totals of the ranges before are added: a group
with a large share of all values is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved, small_side

#: (alpha, beta) of the definitions with the place n q + alpha + q (1 - alpha - beta) - 1.
PLOTTING = {"interpolated_inverted_cdf": (0.0, 1.0), "hazen": (0.5, 0.5), "weibull": (0.0, 0.0), "linear": (1.0, 1.0), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}
METHODS = (*PLOTTING, "inverted_cdf", "averaged_inverted_cdf", "closest_observation", "lower", "higher", "midpoint", "nearest")


def _place(n: Column, q: float, method: str) -> tuple[Column, Column]:
    """(0-based place below, share of the value above)."""
    n = n.cast("double")
    if method in PLOTTING:
        a, b = PLOTTING[method]
        at = n * q + (a + q * (1 - a - b)) - 1
        below = F.floor(at)
        return below, at - below
    if method in ("inverted_cdf", "averaged_inverted_cdf"):
        at = n * q - 1
        below = F.floor(at)
        whole = at == below
        return below, F.when(whole, 0.0 if method == "inverted_cdf" else 0.5).otherwise(1.0)
    if method == "closest_observation":
        at = n * q - 1.5
        below = F.floor(at)
        return below, F.when((at == below) & (below % 2 == 1), 0.0).otherwise(1.0)
    at = (n - 1) * q
    below = F.floor(at)
    if method == "lower":
        return below, F.lit(0.0)
    if method == "higher":
        return F.ceil(at), F.lit(0.0)
    if method == "nearest":
        return F.rint(at).cast("long"), F.lit(0.0)
    if method == "midpoint":
        return below, F.when(at == below, 0.0).otherwise(0.5)
    raise ValueError(f"unknown method {method!r}")


def _ranked(counted: DataFrame, by: list[str], weight: str) -> DataFrame:
    """``counted`` (by, _v and ``weight``) with _end, the running sum of weights in each group, _n, the group's sum, and _nan, its largest value."""
    ranged = counted.repartitionByRange(*by, "_v").sortWithinPartitions(*by, "_v").withColumn("_part", F.spark_partition_id())
    ranged = saved(ranged, "ranks")
    # A range has few groups or is within one, so these are hardly more rows than ranges and groups.
    totals = ranged.groupBy("_part", *by).agg(F.sum(weight).alias("_t"), F.max("_v").alias("_top"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"), F.sum("_t").over(group).alias("_n"), F.max("_top").over(group).alias("_nan"))
    totals = saved(totals.withColumnRenamed("_part", "_of"), "totals")
    on = F.col("_part") == F.col("_of")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    within = Window.partitionBy("_part", *by).orderBy("_v")
    return ranged.join(small_side(totals), on).withColumn("_end", F.col("_before") + F.sum(weight).over(within))


def quantiles(df: DataFrame, by: list[str], value: str, q: list[float], method: str = "linear", ignore_nan: bool = False) -> DataFrame:
    """The columns ``by``, q and quantile for each group and each of ``q`` (0 to 1).

    A group with a NaN has NaN quantiles, unless NaNs are ignored.  NULL values
    are left out; a group without values has no rows.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if ignore_nan:
        rows = rows.filter(~F.isnan("_v"))
    counted = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_m"))
    ranked = _ranked(counted, by, "_m")
    parts = []
    for x in q:
        below, share = _place(F.col("_n"), x, method)
        lo = F.greatest(F.least(below, F.col("_n") - 1), F.lit(0))
        hi = F.greatest(F.least(below + 1, F.col("_n") - 1), F.lit(0))
        at = lambda place: F.max(F.when((place < F.col("_end")) & (place >= F.col("_end") - F.col("_m")), F.col("_v")))  # noqa: B023, E731
        parts += [at(lo), at(hi), F.first(F.when(below < 0, F.lit(0.0)).otherwise(share))]
    out = ranked.groupBy(*by).agg(F.max("_nan").alias("_nan"), *(c.alias(f"_{k}") for k, c in enumerate(parts)))
    entries = []
    for k, x in enumerate(q):
        lo, hi, share = (F.col(f"_{3 * k + j}") for j in range(3))
        value = F.when(F.isnan("_nan"), float("nan")).when((share == 0) | (lo == hi), lo).when(share == 1, hi).otherwise(lo + (hi - lo) * share)
        entries.append(F.struct(F.lit(x).alias("q"), value.alias("quantile")))
    return out.select(*by, F.inline(F.array(*entries)))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, q: list[float]) -> DataFrame:
    """Inverted-CDF quantiles with weights: the first value whose share of the total weight reaches q."""
    counted = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    ranked = _ranked(counted, by, "_w")
    out = ranked.groupBy(*by).agg(*(F.min(F.when(F.col("_end") / F.col("_n") >= x, F.col("_v"))).alias(f"_{k}") for k, x in enumerate(q)))
    return out.select(*by, F.inline(F.array(*(F.struct(F.lit(x).alias("q"), F.col(f"_{k}").alias("quantile")) for k, x in enumerate(q)))))
