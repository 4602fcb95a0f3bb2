"""Stacks of small real matrices solved within a row, by higher-order functions of arrays.

A matrix is an array of rows in one cell.  Elimination, and the columns of a
triangular factor, are folds over the matrix's places that run inside the JVM:
no Python worker sees a row, and the stack may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame, idx


def cells(x: NDFrame) -> DataFrame:
    """Leading indices and each place's matrix ``m`` as an array of rows."""
    lead = x.ndim - 2
    row, column = f"i{lead}", f"i{lead + 1}"
    entries = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(column).alias("c"), F.col("v").cast("double").alias("v"))))
    flat = F.transform(F.col("_e"), lambda e: e["v"])
    m = F.transform(F.sequence(F.lit(0), F.lit(x.shape[-2] - 1)), lambda r: F.slice(flat, r * x.shape[-1] + 1, x.shape[-1]))
    return x.df.groupBy(*idx(lead)).agg(entries.alias("_e")).select(*idx(lead), m.alias("m"))


def matrices(df: DataFrame, lead: int, m: Column, shape: list[int]) -> NDFrame:
    """The array of matrices in a column of cells."""
    rows = df.select(*idx(lead), F.posexplode(m).alias("_r", "_row")).select(*idx(lead), F.col("_r").cast("long").alias(f"i{lead}"), F.posexplode("_row").alias("_c", "v"))
    return NDFrame(rows.withColumn(f"i{lead + 1}", F.col("_c").cast("long")), shape)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def eliminated(m: Column, n: int) -> Column:
    """struct(m, det, sign, log): Gauss-Jordan elimination of the first ``n`` columns of n rows with partial pivoting, and the determinant.

    A column without a pivot leaves the matrix as it is and makes the
    determinant 0.
    """
    rows = F.sequence(F.lit(0), F.lit(n - 1))

    def step(s: Column, k: Column) -> Column:
        best = F.array_max(F.transform(F.sequence(k, F.lit(n - 1)), lambda i: F.struct(F.abs(F.get(F.get(s["m"], i), k)).alias("size"), (-i).alias("less"))))
        at = _bound(best, lambda b: F.struct((-b["less"]).alias("at"), F.get(F.get(s["m"], -b["less"]), k).alias("pivot")))
        return _bound(at, lambda p: cleared_by(s, k, p))

    def cleared_by(s: Column, k: Column, p: Column) -> Column:
        row, pivot = F.get(s["m"], p["at"]), p["pivot"]
        safe = F.when(pivot == 0, 1.0).otherwise(pivot)
        swapped = F.transform(rows, lambda i: F.when(i == k, row).when(i == p["at"], F.get(s["m"], k)).otherwise(F.get(s["m"], i)))
        cleared = F.transform(swapped, lambda r, i: F.when(i == k, F.transform(row, lambda v: v / safe)).otherwise(F.zip_with(r, row, lambda a, b: a - b * (F.get(r, k) / safe))))
        turn = F.when(p["at"] == k, 1.0).otherwise(-1.0)
        return F.struct(
            F.when(pivot == 0, s["m"]).otherwise(cleared).alias("m"),
            (s["det"] * pivot * turn).alias("det"),
            (s["sign"] * F.signum(pivot) * turn).alias("sign"),
            (s["log"] + F.when(pivot == 0, float("-inf")).otherwise(F.log(F.abs(safe)))).alias("log"),
        )

    start = F.struct(m.alias("m"), F.lit(1.0).alias("det"), F.lit(1.0).alias("sign"), F.lit(0.0).alias("log"))
    return F.aggregate(rows, start, step)


def _regular(done: Column, value: Column) -> Column:
    """``value`` if every column had a pivot; the determinant itself may underflow."""
    return F.when(done["sign"] == 0, F.raise_error(F.lit("a matrix is singular"))).otherwise(value)


def det(x: NDFrame, part: str = "det") -> NDFrame:
    """The determinant of each matrix; with ``part`` sign or log, those of its size."""
    lead = x.ndim - 2
    return NDFrame(cells(x).select(*idx(lead), eliminated(F.col("m"), x.shape[-1])[part].alias("v")), x.shape[:lead])


def inv(x: NDFrame) -> NDFrame:
    n, lead = x.shape[-1], x.ndim - 2
    unit = F.transform(F.col("m"), lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0))))
    done = cells(x).select(*idx(lead), eliminated(unit, n).alias("s"))
    right = F.transform(F.col("s.m"), lambda row: F.slice(row, n + 1, n))
    return matrices(done, lead, _regular(F.col("s"), right), list(x.shape))


def solve(wide: NDFrame) -> NDFrame:
    """The solutions of stacks of equations, each a matrix with its right side as a last column."""
    n, lead = wide.shape[-2], wide.ndim - 2
    done = cells(wide).select(*idx(lead), eliminated(F.col("m"), n).alias("s"))
    last = _regular(F.col("s"), F.transform(F.col("s.m"), lambda row: F.get(row, F.lit(n))))
    rows = done.select(*idx(lead), F.posexplode(last).alias("_r", "v"))
    return NDFrame(rows.withColumn(f"i{lead}", F.col("_r").cast("long")), wide.shape[:-1])


def cholesky(x: NDFrame) -> NDFrame:
    """The lower triangular factors of stacks of positive definite matrices, row by row."""
    n, lead = x.shape[-1], x.ndim - 2

    def total(a: Column, b: Column, j: Column) -> Column:
        products = F.zip_with(F.slice(a, F.lit(1), j), F.slice(b, F.lit(1), j), lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    def row(done: Column, i: Column) -> Column:
        own = F.get(F.col("m"), i)

        def entry(acc: Column, j: Column) -> Column:
            above = F.get(done, j)
            on = F.get(own, j) - total(acc, acc, j)
            root = F.when(on > 0, F.sqrt(on)).otherwise(F.raise_error(F.lit("a matrix isn't positive definite")))
            return F.concat(acc, F.array(F.when(i == j, root).otherwise((F.get(own, j) - total(acc, above, j)) / F.get(above, j))))

        made = F.aggregate(F.sequence(F.lit(0), i), F.array().cast("array<double>"), entry)
        return F.concat(done, F.array(F.concat(made, F.array_repeat(F.lit(0.0), F.lit(n - 1) - i))))

    factor = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<array<double>>"), row)
    return matrices(cells(x).select(*idx(lead), factor.alias("l")), lead, F.col("l"), list(x.shape))
