"""Sorting, searching and set operations on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered, saved, small_side


def order(column: str, descending: bool = False) -> list[Column]:
    """Sort keys that put NaN last either way."""
    c = F.col(column)
    return [F.isnan(c.cast("double")), c.desc() if descending else c.asc()]


def sort(df: DataFrame, column: str, descending: bool = False, ties: list | None = None) -> DataFrame:
    """``df`` with ``pos``, the place of each row in the order; equal values by ``ties``."""
    return numbered(df, [*order(column, descending), *(ties or [])])


def argsort(df: DataFrame, column: str, index: str) -> DataFrame:
    """pos and the index of the row that belongs there; equal values in the order of the index."""
    return numbered(df.select(index, column), [*order(column), F.col(index)]).select("pos", index)


def lexsort(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """As argsort by several keys, the last one first."""
    return numbered(df.select(index, *keys), [*(F.col(k) for k in reversed(keys)), F.col(index)]).select("pos", index)


def top(df: DataFrame, column: str, k: int, largest: bool = True, ties: list | None = None) -> DataFrame:
    """The k largest (or smallest) rows: each task keeps k at most."""
    return df.orderBy(*order(column, largest), *(ties or [])).limit(k)


def searchsorted(df: DataFrame, column: str, keys: DataFrame, key: str, right: bool = False) -> DataFrame:
    """``keys`` with ``place``: how many values are below each key (or not above it, with ``right``).

    Values are counted once by value, and a union of values and keys is ranked
    with running sums over ranges: no pair of value and key is formed.
    """
    values = df.groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")).select("x", F.lit(1 if not right else 0).alias("kind"), "n")
    wanted = keys.select(F.col(key).cast("double").alias("x")).distinct().select("x", F.lit(0 if not right else 1).alias("kind"), F.lit(0).cast("long").alias("n"))
    ranged = saved(values.union(wanted).repartitionByRange("x", "kind").sortWithinPartitions("x", "kind").withColumn("part", F.spark_partition_id()), "ranges")
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, table = 0, []
    for part, n in sums:
        table.append((part, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(table, "part int, before long"))
    w = Window.partitionBy("part").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("own", F.sum("n").over(w)).join(offsets, "part").filter(F.col("kind") == (1 if right else 0)).select(F.col("x").alias("_x"), (F.col("own") + F.col("before")).alias("place"))
    return keys.join(found, keys[key].cast("double") == F.col("_x")).drop("_x")


def unique(df: DataFrame, column: str, index: str | None = None) -> DataFrame:
    """value, count and (with an index) first_index, of each different value; NaNs are one value."""
    more = [F.min(index).alias("first_index")] if index else []
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"), *more)


def unique_inverse(df: DataFrame, column: str, index: str) -> DataFrame:
    """index and inverse: the place of each row's value among the sorted different values."""
    values = numbered(df.select(column).distinct(), order(column), "inverse")
    return df.select(index, column).join(small_side(values), column).select(index, "inverse")


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """value: the different values; NaNs are one."""
    return df.select(F.col(column).alias("value")).distinct()


def unique_all(df: DataFrame, column: str, index: str) -> DataFrame:
    """index, value, first_index, inverse and count of every row: all that is known of its value."""
    values = numbered(unique(df, column, index), order("value"), "inverse")
    rows = df.select(index, F.col(column).alias("value"))
    return rows.join(small_side(values), "value").select(index, "value", "first_index", "inverse", "count")


def isin(df: DataFrame, column: str, table: DataFrame, other: str, invert: bool = False) -> DataFrame:
    """``df`` with ``member``."""
    known = table.select(F.col(other).alias("_m")).dropna().distinct().withColumn("_in", F.lit(True))
    member = F.coalesce("_in", F.lit(False))
    return df.join(known, df[column] == known["_m"], "left").withColumn("member", ~member if invert else member).drop("_m", "_in")


def intersect1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return a.select(F.col(x).alias("value")).intersect(b.select(F.col(y).alias("value")))


def union1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return a.select(F.col(x).alias("value")).union(b.select(F.col(y).alias("value"))).distinct()


def setdiff1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return a.select(F.col(x).alias("value")).subtract(b.select(F.col(y).alias("value")))


def setxor1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """Values of one side only: both sides' marks are counted in one aggregation."""
    both = a.select(F.col(x).alias("value"), F.lit(1).alias("side")).union(b.select(F.col(y).alias("value"), F.lit(2).alias("side")))
    return both.groupBy("value").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo = hi").select("value")
