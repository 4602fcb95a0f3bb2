"""Lanes arranged around their k-th value without sorting them.

Every round takes pivots from a mergeable sketch of what may still be the k-th
value of a lane, counts the values between and at the pivots, and keeps the
range that holds it; a round leaves about one in PIVOTS.  Only what fits in WHOLE
rows is ordered.  Then each element's place is the number of elements before it
in its class (below, equal, above), from counts of blocks, so that no task sees
a lane however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NDFrame, normal_axis
from ..storage import saved, small_side

WHOLE, PIVOTS, BLOCK = 1 << 16, 63, 1 << 16


def _lanes(x: NDFrame, axis: int) -> tuple[DataFrame, list[str]]:
    others = [f"i{k}" for k in range(x.ndim) if k != axis]
    lane = F.lit(0).cast("long")
    for k in range(x.ndim):
        if k != axis:
            lane = lane * x.shape[k] + F.col(f"i{k}")
    return x.df.withColumn("_lane", lane), others


def kth_values(rows: DataFrame, kth: int) -> DataFrame:
    """_lane and pivot, the value of rank ``kth`` of each lane of (_lane, v); NaNs rank last."""
    known = rows.filter(~F.isnan(F.col("v").cast("double"))).select("_lane", "v")
    total = saved(rows.groupBy("_lane").agg(F.count_if(~F.isnan(F.col("v").cast("double"))).alias("n")), "lanes")
    done = total.filter(F.col("n") <= kth).select("_lane", F.lit(float("nan")).cast(rows.schema["v"].dataType).alias("pivot")) if dict(rows.dtypes)["v"] in ("double", "float") else None
    left = known.join(small_side(total.filter(F.col("n") > kth).select("_lane", F.lit(kth).cast("long").alias("k"))), "_lane")
    fractions = [(p + 1) / (PIVOTS + 1) for p in range(PIVOTS)]
    most = total.agg(F.max("n")).first()[0] or 0
    while most > WHOLE:
        pivots = saved(left.groupBy("_lane").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", fractions, 10_000))).alias("p")), "pivots")
        both = left.join(small_side(pivots, size=F.lit(8 * PIVOTS)), "_lane")
        both = both.withColumn("b", 2 * F.size(F.filter("p", lambda p: p < F.col("v"))) + F.array_contains("p", F.col("v")).cast("int"))
        counts = both.groupBy("_lane", "b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.first("k").alias("k"))
        upto = F.sum("c").over(Window.partitionBy("_lane").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        held = saved(counts.withColumn("upto", upto).filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k"))), "held")
        found = held.filter("b % 2 = 1").select("_lane", F.col("least").alias("pivot"))
        done = found if done is None else done.unionByName(found)
        rest = held.filter("b % 2 = 0").select("_lane", "b", (F.col("k") - F.col("upto") + F.col("c")).alias("_k"))
        left = saved(both.join(small_side(rest), ["_lane", "b"]).select("_lane", "v", F.col("_k").alias("k")), "left")
        most = left.groupBy("_lane").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    at = F.row_number().over(Window.partitionBy("_lane").orderBy("v"))
    last = left.withColumn("at", at).filter(F.col("at") == F.col("k") + 1).select("_lane", F.col("v").alias("pivot"))
    return last if done is None else last.unionByName(done)


def arranged(x: NDFrame, kth: int, axis: int = -1) -> NDFrame:
    """The lanes' elements with ``_from``, their place before: those below the k-th value first, then equal ones, then those above, each in the order they had."""
    axis = normal_axis(axis, x.ndim)
    if x.dtype.kind == "c":
        raise TypeError("complex lanes of this length aren't partitioned")
    n = x.shape[axis]
    kth = normal_axis(kth, n)
    rows, others = _lanes(x, axis)
    pivots = saved(kth_values(rows, kth), "kth")
    i = F.col(f"i{axis}")
    nan = F.isnan(F.col("v").cast("double"))
    below = (F.col("v") < F.col("pivot")) & ~nan
    same = (F.col("v") == F.col("pivot")) | (nan & F.isnan(F.col("pivot").cast("double")))
    classed = rows.join(small_side(pivots), "_lane").withColumns({"_class": F.when(below, 0).when(same, 1).otherwise(2).cast("long"), "_block": F.floor(i / BLOCK)})
    blocks = -(-n // BLOCK)
    counts = classed.groupBy("_lane", "_block").agg(*(F.count_if(F.col("_class") == c).alias(f"c{c}") for c in range(3)))
    flat = counts.select(F.col("_lane").alias("i0"), F.inline(F.array(*(F.struct((F.lit(c) * blocks + F.col("_block")).cast("long").alias("i1"), F.col(f"c{c}").alias("v")) for c in range(3)))))
    lanes = math.prod(x.shape) // n if n else 0
    upto = NDFrame(flat, [lanes, 3 * blocks], "int64").scan(F.sum, lambda a, b: a + b, 1).df
    before = saved(upto.join(flat.withColumnRenamed("v", "own"), ["i0", "i1"]).select(F.col("i0").alias("_lane"), F.floor(F.col("i1") / blocks).alias("_class"), (F.col("i1") % blocks).alias("_block"), (F.col("v") - F.col("own")).alias("_before")), "before")
    inside = F.row_number().over(Window.partitionBy("_lane", "_block", "_class").orderBy(i)) - 1
    placed = classed.withColumn("_inside", inside).join(small_side(before), ["_lane", "_block", "_class"])
    out = NDFrame.__new__(NDFrame)
    out.df = placed.select(*others, i.alias("_from"), (F.col("_before") + F.col("_inside")).cast("long").alias(f"i{axis}"), "v")
    out.shape, out.dtype = x.shape, x.dtype
    return out

