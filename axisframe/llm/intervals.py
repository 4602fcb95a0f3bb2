"""Nearest smaller values and totals of intervals over one long array, in blocks.

The array is a table of places and values.  A task sees one block; what a block
can't answer goes to the array of block minima (or totals), which is cut into
blocks itself, and so on: the number of steps is the logarithm of the length to
the base of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

BLOCK = 1024

_ASKED = "block long, up boolean, v long, at long"


def _of(column: str, size: int):
    return F.floor(F.col(column) / size).cast("long")


def _arrays(t: pa.Table, *names: str) -> list[np.ndarray]:
    out = [t[n].to_numpy() for n in names]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def _in_block(t: pa.Table) -> pa.Table:
    """Each place's nearest smaller values on both sides within its block, by a stack."""
    i, x = (a.tolist() for a in _arrays(t, "i", "x"))
    left, right, stack = [None] * len(i), [None] * len(i), []
    for k, v in enumerate(x):
        while stack and x[stack[-1]] > v:
            right[stack.pop()] = k
        # Equal values stay on the stack: their nearest smaller one is that of the first of them.
        left[k] = (left[stack[-1]] if x[stack[-1]] == v else stack[-1]) if stack else None
        stack.append(k)
    whole = lambda a, of: pa.array([None if k is None else of[k] for k in a], pa.int64())
    return pa.table({"i": pa.array(i, pa.int64()), "x": pa.array(x, pa.int64()), "l": whole(left, i), "lx": whole(left, x), "h": whole(right, i), "hx": whole(right, x)})


def _nearest(values: pa.Table, asked: pa.Table, beyond: bool) -> pa.Table:
    """The nearest place with a value below v: beyond the place ``block``, or of the whole block from its near end."""
    i, x = _arrays(values, "i", "x") if values.num_rows else (np.zeros(0, np.int64),) * 2
    out, below = [], {}
    for block, up, v in zip(*(asked[c].to_pylist() for c in ("block", "up", "v"))):
        if v not in below:
            below[v] = i[x < v]
        own = below[v]
        k = (np.searchsorted(own, block, "right") if up else np.searchsorted(own, block) - 1) if beyond else (0 if up else len(own) - 1)
        out.append(int(own[k]) if 0 <= k < len(own) else None)
    return pa.table({"block": asked["block"], "up": asked["up"], "v": asked["v"], "at": pa.array(out, pa.int64())})


def _within(values: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """For (block, up, v, at): the near end's first place below v in the block ``at``."""
    grouped = values.withColumn("g", _of("i", size)).groupBy("g").cogroup(asked.withColumnRenamed("at", "g").groupBy("g"))
    return grouped.applyInArrow(lambda key, a, b: _nearest(a, b, False), _ASKED)


def _outside(minima: DataFrame, n: int, asked: DataFrame, size: int) -> DataFrame:
    """For (block, up, v): the nearest block in that direction whose minimum is below v."""
    grouped = minima.withColumn("g", _of("i", size)).groupBy("g").cogroup(asked.withColumn("g", _of("block", size)).groupBy("g"))
    found = saved(grouped.applyInArrow(lambda key, a, b: _nearest(a, b, True), _ASKED), "nearest")
    if n <= size:
        return found
    rest = found.filter("at is null").drop("at").withColumn("own", F.col("block")).withColumn("block", _of("block", size))
    upper = _outside(minima.groupBy(_of("i", size).alias("i")).agg(F.min("x").alias("x")), -(-n // size), rest.drop("own").distinct(), size)
    more = rest.join(_within(minima, upper, size), ["block", "up", "v"]).select(F.col("own").alias("block"), "up", "v", "at")
    return saved(found.filter("at is not null").unionByName(more), "nearest")


def nearest_smaller(values: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    """i, x, l, lx, h, hx: each place's nearest smaller values before and behind it, with their places.

    ``values`` (i, x) has the places 0 to n - 1.  A side on which nothing is
    smaller has nulls; both ends should hold a least value.
    """
    own = saved(values.withColumn("g", _of("i", size)).groupBy("g").applyInArrow(lambda key, t: _in_block(t), "i long, x long, l long, lx long, h long, hx long"), "nearest")
    if n <= size:
        return own
    inner = own.withColumn("block", _of("i", size))
    least = own.agg(F.min("x")).first()[0]
    asked = inner.filter(F.col("x") > least).select("block", F.col("x").alias("v"), F.explode(F.array_compact(F.array(F.when(F.col("l").isNull(), False), F.when(F.col("h").isNull(), True)))).alias("up")).distinct()
    minima = values.groupBy(_of("i", size).alias("i")).agg(F.min("x").alias("x"))
    at = _within(values, _outside(minima, -(-n // size), asked, size).filter("at is not null"), size)
    at = at.join(values.select(F.col("i").alias("at"), F.col("x").alias("ax")), "at")
    for up, place, value in ((False, "l", "lx"), (True, "h", "hx")):
        side = at.filter(F.col("up") == up).select("block", F.col("v").alias("x"), "at", "ax")
        inner = inner.join(side, ["block", "x"], "left").withColumns({place: F.coalesce(place, "at"), value: F.coalesce(value, "ax")}).drop("at", "ax")
    return saved(inner.drop("block"), "nearest")


def _totals(values: pa.Table, asked: pa.Table, least: str | None, sums: list[str]) -> pa.Table:
    names = [*([least] if least else []), *sums]
    out = {c: asked[c] for c in ("a0", "b0")}
    i, *arrays = _arrays(values, "i", *names) if values.num_rows else [np.zeros(0, np.int64)] * (len(names) + 1)
    lo, hi = (np.searchsorted(i, asked[c].to_numpy()) for c in ("a", "b"))
    for name, x in zip(names, arrays):
        if name == least:
            table, step = [x], 1  # minima of 1, 2, 4 ... places
            while 2 * step <= len(x):
                table.append(np.minimum(table[-1][:-step], table[-1][step:]))
                step *= 2
            level = np.frexp(np.maximum(hi - lo, 1))[1] - 1
            got = np.zeros(len(lo), np.int64)
            for k, row in enumerate(table):
                own = level == k
                got[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << k)])
            out[name] = pa.array(got)
        else:
            total = np.concatenate(([0], np.cumsum(x)))
            out[name] = pa.array(total[hi] - total[lo], pa.int64())
    return pa.table(out)


def interval_totals(values: DataFrame, asked: DataFrame, n: int, least: str | None, sums: list[str], size: int = BLOCK) -> DataFrame:
    """For each (a, b) of ``asked``: the least ``least`` and the ``sums`` of the places a to b - 1 of ``values`` (i, ...), 0 to n - 1."""
    names = [*([least] if least else []), *sums]
    schema = "a0 long, b0 long, " + ", ".join(f"{c} long" for c in names)
    folds = [*([F.min(least).alias(least)] if least else []), *(F.sum(c).alias(c) for c in sums)]
    queries, parts = asked.select(F.col("a").alias("a0"), F.col("b").alias("b0"), "a", "b"), None
    while True:
        first, last = _of("a", size), F.floor((F.col("b") - 1) / size).cast("long")
        end = lambda g: (g + 1) * size
        pieces = F.when(first == last, F.array(F.struct(first.alias("g"), F.col("a").alias("a"), F.col("b").alias("b")))).otherwise(F.array(F.struct(first.alias("g"), F.col("a").alias("a"), end(first).alias("b")), F.struct(last.alias("g"), (last * size).alias("a"), F.col("b").alias("b"))))
        cut = queries.select("a0", "b0", F.explode(pieces).alias("p")).select("a0", "b0", "p.g", "p.a", "p.b")
        found = values.select("i", *names, _of("i", size).alias("g")).groupBy("g").cogroup(cut.groupBy("g")).applyInArrow(lambda key, a, b: _totals(a, b, least, sums), schema)
        parts = found if parts is None else parts.unionByName(found)
        if n <= size:
            break
        queries = queries.filter(last - first > 1).select("a0", "b0", (first + 1).alias("a"), last.alias("b"))
        values, n = values.groupBy(_of("i", size).alias("i")).agg(*folds), -(-n // size)
    return parts.groupBy(F.col("a0").alias("a"), F.col("b0").alias("b")).agg(*folds)
