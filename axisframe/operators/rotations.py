"""Orthogonal factors of stacks of small real matrices, inside the JVM.

Columns are arrays in one cell.  Rotations of pairs of columns until all are
orthogonal (one-sided Jacobi) give singular values and vectors; a symmetric
matrix is moved by its largest row sum first, so that its eigenvalues are
singular values.  Reflections (Householder) give QR.  All are folds of
higher-order functions; no Python worker sees a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame, idx
from ..storage import saved
from .elimination import _bound, cells, matrices

EPS = 2.0**-52


def _range(a, b) -> Column:
    """a to b - 1; empty if b isn't above a."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.when(b > a, F.sequence(a, F.greatest(b - 1, a))).otherwise(F.array().cast("array<int>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _rotated(columns: Column, p: Column, q: Column, m: int) -> Column:
    """The columns after p and q, whose first m places count, are made orthogonal."""
    a, b = F.get(columns, p), F.get(columns, q)
    head = lambda c: F.slice(c, 1, m)
    sums = F.struct(dot(head(a), head(a)).alias("a"), dot(head(b), head(b)).alias("b"), dot(head(a), head(b)).alias("g"))

    def turned(s: Column) -> Column:
        zeta = (s["b"] - s["a"]) / (2 * s["g"])
        t = F.when(zeta >= 0, 1.0).otherwise(-1.0) / (F.abs(zeta) + F.sqrt(1 + zeta * zeta))
        return _bound(t, lambda t: _bound(1 / F.sqrt(1 + t * t), lambda c: F.transform(columns, lambda x, i: F.when(i == p, F.zip_with(a, b, lambda u, v: c * u - c * t * v)).when(i == q, F.zip_with(a, b, lambda u, v: c * t * u + c * v)).otherwise(x))))

    return _bound(sums, lambda s: F.when(F.abs(s["g"]) <= EPS * F.sqrt(s["a"]) * F.sqrt(s["b"]), columns).otherwise(turned(s)))


def orthogonal(columns: Column, m: int, n: int) -> Column:
    """Columns (m places, and then those that go along) whose first m places are orthogonal."""
    sweeps = 2 if n == 2 else 8 if n <= 8 else 12

    def sweep(done: Column, _: Column) -> Column:
        return F.aggregate(_range(0, n - 1), done, lambda d, p: F.aggregate(_range(p + 1, n), d, lambda e, q: _rotated(e, p, q, m)))

    return columns if n < 2 else F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), columns, sweep)


def _with_unit(columns: Column, n: int) -> Column:
    return F.transform(columns, lambda c, i: F.concat(c, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0))))


def _decomposed(x: NDFrame) -> DataFrame:
    """For each matrix of m >= n: ``parts``, structs (less, s, a, v) by falling singular value s: its column of U times s, and of V."""
    *_, m, n = x.shape
    lead = x.ndim - 2

    def parts(columns: Column, size: Column) -> Column:
        scaled = F.transform(columns, lambda c: F.transform(c, lambda v: v / size))

        def part(c: Column) -> Column:
            a = F.slice(c, 1, m)
            return _bound(F.sqrt(dot(a, a)), lambda s: F.struct((-s).alias("less"), (s * size).alias("s"), F.transform(a, lambda v: v * size).alias("a"), F.slice(c, m + 1, n).alias("v")))

        return F.array_sort(F.transform(orthogonal(_with_unit(scaled, n), m, n), part))

    def sized(columns: Column) -> Column:
        size = F.array_max(F.transform(columns, lambda c: F.array_max(F.transform(c, F.abs))))
        return _bound(F.when(size > 0, size).otherwise(1.0), lambda s: parts(columns, s))

    # Columns of a DataFrame that are used twice are worked out twice, in lambdas for each element; bound values aren't.
    return cells(x.swapaxes(lead, lead + 1)).select(*idx(lead), _bound(F.col("m"), sized).alias("parts"))


def _tall(x: NDFrame) -> tuple[NDFrame, bool]:
    wide = x.shape[-1] > x.shape[-2]
    return (x.swapaxes(x.ndim - 2, x.ndim - 1) if wide else x), wide


def _vector(df: DataFrame, lead: int, value: Column, shape: list[int]) -> NDFrame:
    rows = df.select(*idx(lead), F.posexplode(value).alias("_r", "v"))
    return NDFrame(rows.withColumn(f"i{lead}", F.col("_r").cast("long")), shape)


def svdvals(x: NDFrame) -> NDFrame:
    own, _ = _tall(x)
    lead = x.ndim - 2
    return _vector(_decomposed(own), lead, F.col("parts")["s"], [*x.shape[:lead], own.shape[-1]])


def _completed(parts: Column, m: int) -> Column:
    """Columns of U; one for a singular value of nought is what is left of the unit vector that the others hold least of."""
    tiny = F.get(parts, F.lit(0))["s"] * EPS

    def one(done: Column, p: Column) -> Column:
        left = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct((1 - F.aggregate(done, F.lit(0.0), lambda s, u: s + F.get(u, i) * F.get(u, i))).alias("size"), (-i).alias("less")))
        start = _bound(F.array_max(left), lambda b: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.when(j == -b["less"], 1.0).otherwise(0.0)))
        freed = lambda v: F.aggregate(done, v, lambda w, u: _bound(dot(w, u), lambda d: F.zip_with(w, u, lambda a, b: a - d * b)))
        new = _bound(freed(freed(start)), lambda v: _bound(F.sqrt(dot(v, v)), lambda s: F.transform(v, lambda y: y / s)))
        return F.concat(done, F.array(F.when(p["s"] > tiny, F.transform(p["a"], lambda v: v / p["s"])).otherwise(new)))

    return F.aggregate(parts, F.array().cast("array<array<double>>"), one)


def svd(x: NDFrame) -> tuple[NDFrame, NDFrame, NDFrame]:
    """U, the singular values and V^H, the thin ones, factored once."""
    own, wide = _tall(x)
    *shape, m, n = own.shape
    lead = len(shape)
    done = saved(_decomposed(own), "svd")
    u = matrices(done, lead, _completed(F.col("parts"), m), [*shape, n, m])  # columns as rows
    v = matrices(done, lead, F.col("parts")["v"], [*shape, n, n])
    s = _vector(done, lead, F.col("parts")["s"], [*shape, n])
    return (v.swapaxes(lead, lead + 1), s, u) if wide else (u.swapaxes(lead, lead + 1), s, v)


def pinv(x: NDFrame, rcond: float = 1e-15) -> NDFrame:
    """Sums of v u^T / s over the singular values above ``rcond`` times the largest."""
    own, wide = _tall(x)
    *shape, m, n = own.shape
    lead = len(shape)
    kept = _bound(F.col("parts"), lambda parts: F.filter(parts, lambda p: p["s"] > F.get(parts, F.lit(0))["s"] * rcond))
    rows = _bound(kept, lambda k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(k, F.array_repeat(F.lit(0.0), m), lambda t, p: F.zip_with(t, p["a"], lambda s, a: s + a * (F.get(p["v"], i) / p["s"] / p["s"])))))
    out = matrices(_decomposed(own), lead, rows, [*shape, n, m])
    return out.swapaxes(lead, lead + 1) if wide else out


def matrix_rank(x: NDFrame) -> NDFrame:
    own, _ = _tall(x)
    lead = x.ndim - 2
    rank = _bound(F.col("parts")["s"], lambda s: F.size(F.filter(s, lambda v: v > F.get(s, F.lit(0)) * (own.shape[-2] * EPS))))
    return NDFrame(_decomposed(own).select(*idx(lead), rank.cast("double").alias("v")), x.shape[:lead])


def cond(x: NDFrame) -> NDFrame:
    """The largest singular value over the least; infinite if that is nought."""
    own, _ = _tall(x)
    lead = x.ndim - 2

    def ratio(s: Column) -> Column:
        least = F.get(s, F.lit(own.shape[-1] - 1))
        return F.when(least == 0, float("inf")).otherwise(F.get(s, F.lit(0)) / F.when(least == 0, 1.0).otherwise(least))

    ratio = _bound(F.col("parts")["s"], ratio)
    return NDFrame(_decomposed(own).select(*idx(lead), ratio.alias("v")), x.shape[:lead])


def _symmetric(x: NDFrame) -> DataFrame:
    """For each symmetric matrix, of which the lower half counts: ``parts``, structs (w, v) by rising eigenvalue."""
    n, lead = x.shape[-1], x.ndim - 2
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def whole(m: Column) -> Column:
        return F.transform(places, lambda i: F.transform(places, lambda j: F.get(F.get(m, F.greatest(i, j)), F.least(i, j))))

    def moved(m: Column, by: Column) -> Column:
        own = F.transform(m, lambda r, i: F.transform(r, lambda v, j: v + F.when(i == j, by).otherwise(0.0)))

        def part(c: Column) -> Column:
            a = F.slice(c, 1, n)
            return F.struct((F.sqrt(dot(a, a)) - by).alias("w"), F.slice(c, n + 1, n).alias("v"))

        return F.array_sort(F.transform(orthogonal(_with_unit(own, n), n, n), part))

    def shifted(m: Column) -> Column:
        by = F.array_max(F.transform(m, lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + F.abs(v))))
        return _bound(by, lambda b: moved(m, b))

    return cells(x).select(*idx(lead), _bound(_bound(F.col("m"), whole), shifted).alias("parts"))


def eigvalsh(x: NDFrame) -> NDFrame:
    return _vector(_symmetric(x), x.ndim - 2, F.col("parts")["w"], list(x.shape[:-1]))


def eigh(x: NDFrame) -> tuple[NDFrame, NDFrame]:
    lead = x.ndim - 2
    done = saved(_symmetric(x), "eigh")
    return _vector(done, lead, F.col("parts")["w"], list(x.shape[:-1])), matrices(done, lead, F.col("parts")["v"], list(x.shape)).swapaxes(lead, lead + 1)


def qr(x: NDFrame) -> tuple[NDFrame, NDFrame]:
    """The thin Q and R by reflections, factored once."""
    *shape, m, n = x.shape
    lead, k = len(shape), min(m, n)
    unit = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))

    def step(columns: Column, j: Column) -> Column:
        x0 = F.transform(F.get(columns, j), lambda v, i: F.when(i >= j, v).otherwise(0.0))

        def reflected(c: Column) -> Column:
            size = F.sqrt(dot(c, c))
            own = F.get(c, j)
            v = _bound(own + F.when(own >= 0, size).otherwise(-size), lambda top: F.transform(c, lambda y, i: F.when(i == j, top).otherwise(y)))
            # A column with nothing below its own place stays as it is.
            flat = size == F.abs(own)
            return _bound(v, lambda w: _bound(dot(w, w), lambda ww: F.when(flat | (ww == 0), columns).otherwise(F.transform(columns, lambda y: _bound(2 * dot(w, y) / ww, lambda d: F.zip_with(y, w, lambda p, q: p - d * q))))))

        return _bound(x0, reflected)

    columns = cells(x.swapaxes(lead, lead + 1)).select(*idx(lead), F.concat("m", unit).alias("m"))
    done = saved(columns.select(*idx(lead), F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.col("m"), step).alias("m")), "qr")
    upper = F.transform(F.slice("m", 1, n), lambda c, j: F.transform(F.slice(c, 1, k), lambda v, i: F.when(i <= j, v).otherwise(0.0)))
    # The last m columns are those of Q's transpose, which are Q's rows.
    q = matrices(done, lead, F.transform(F.slice("m", n + 1, m), lambda c: F.slice(c, 1, k)), [*shape, m, k])
    return q, matrices(done, lead, upper, [*shape, n, k]).swapaxes(lead, lead + 1)
