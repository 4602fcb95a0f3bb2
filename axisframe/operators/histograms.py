"""Counts by value and by bin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import real as R

RULES = ("auto", "sqrt", "sturges", "rice", "scott", "fd", "doane")


def bin_edges(df: DataFrame, value: str, bins: int | str | list[float] = 10, limits: tuple[float, float] | None = None) -> list[float]:
    """Edges from one pass over the column: a number of bins, a rule, or the edges themselves."""
    if isinstance(bins, (list, tuple)):
        if any(b < a for a, b in zip(bins, bins[1:])):
            raise ValueError("edges must rise")
        return [float(x) for x in bins]
    x = F.col(value).cast("double")
    if limits:
        df = df.filter(x.between(*limits))
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.percentile(x, [0.25, 0.75]).alias("quartiles")).first()
    n = row["n"]
    lo, hi = limits or ((row["lo"], row["hi"]) if n else (0.0, 1.0))
    if not (math.isfinite(lo) and math.isfinite(hi)) or lo > hi:
        raise ValueError(f"no finite range: {lo} to {hi}")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    if isinstance(bins, str):
        bins = max(1, math.ceil((hi - lo) / width)) if n and (width := _width(bins, n, row["hi"] - row["lo"], row)) else 1
    return [lo + (hi - lo) * k / bins for k in range(bins)] + [hi]


def _width(rule: str, n: int, spread: float, row) -> float:
    root, iqr = spread / math.sqrt(n), (row["quartiles"][1] - row["quartiles"][0])
    rules = {
        "sqrt": root,
        "sturges": spread / (math.log2(n) + 1),
        "rice": spread / (2 * n ** (1 / 3)),
        "scott": (24 * math.sqrt(math.pi) / n) ** (1 / 3) * row["sd"],
        "fd": 2 * iqr * n ** (-1 / 3),
    }
    if rule == "auto":
        return min(max(rules["fd"], root / 2), rules["sturges"]) if rules["fd"] else rules["sturges"]
    if rule == "doane":
        if n < 3 or not row["sd"]:
            return 0.0
        sigma = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
        return spread / (1 + math.log2(n) + math.log2(1 + abs(row["skew"]) / sigma))
    if rule not in rules:
        raise ValueError(f"unknown rule {rule!r}")
    return rules[rule]


def bin_of(x: Column, edges: list[float]) -> Column:
    """The 0-based bin: half-open ones, the last closed; NULL outside."""
    x = x.cast("double")
    place = R.digitize(x, edges) - 1
    return F.when(x == edges[-1], F.lit(len(edges) - 2)).when((place >= 0) & (place < len(edges) - 1) & ~F.isnan(x), place)


def even_bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """The same for even bins, by arithmetic in place of a search."""
    x = x.cast("double")
    inside = (x >= lo) & (x <= hi)
    return F.when(inside, F.least(F.floor((x - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, value: str, edges: list[float], weights: str | None = None, density: bool = False) -> DataFrame:
    """bin, low, high and count (or the sum of weights, or a density) of every bin, empty ones included."""
    spark = df.sparkSession
    w = F.sum(F.col(weights).cast("double")) if weights else F.count(F.lit(1))
    counts = df.select(bin_of(F.col(value), edges).alias("bin"), *([weights] if weights else [])).filter("bin is not null").groupBy("bin").agg(w.alias("n"))
    table = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double"))
    out = table.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if density:
        out = out.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("n", F.col("n") / F.col("_all") / (F.col("high") - F.col("low"))).drop("_all")
    return out.withColumnRenamed("n", "density" if density else "count")


def histogramdd(df: DataFrame, edges: dict[str, list[float]], weights: str | None = None) -> DataFrame:
    """bin_<column> for each column and count, of the bins that hold something."""
    rows = df.select(*(bin_of(F.col(c), e).alias(f"bin_{c}") for c, e in edges.items()), *([weights] if weights else []))
    names = [f"bin_{c}" for c in edges]
    return rows.dropna(subset=names).groupBy(*names).agg((F.sum(weights) if weights else F.count(F.lit(1))).alias("count"))


def bincount(df: DataFrame, value: str, weights: str | None = None, minlength: int = 0) -> DataFrame:
    """value and count for every whole number from 0 to the largest one (``minlength`` - 1 at least)."""
    counts = df.groupBy(F.col(value).cast("long").alias("value")).agg((F.sum(F.col(weights).cast("double")) if weights else F.count(F.lit(1))).alias("count"))
    top = counts.agg(F.max("value")).first()[0]
    full = df.sparkSession.range(max(minlength, (top if top is not None else -1) + 1)).toDF("value")
    return full.join(counts, "value", "left").withColumn("count", F.coalesce("count", F.lit(0)))
