"""Queries of index arrays, comparisons, meshes and lanes, over whole tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dtypes
from .frame import NDFrame
from .operators import comparison, contractions, creation, indexing, joining, lanes
from .queries import _M, _S, ORACLE_SQL, QUERIES, _matrix, _query, _rows, _suppliers, _table

#: The places along each row that sort it, and the matrix beside them.
_ORDER = f"(SELECT r, c, v, row_number() OVER (PARTITION BY r ORDER BY v, c) - 1 AS k FROM {_M})"


def _whole(m: NDFrame) -> NDFrame:
    """Hundreds of every element, as whole numbers."""
    return m.map(lambda v: F.floor(v * 100).cast("long"), "int64")


#: name: (array from the matrix, SQL with columns i0, i1, ..., v)
ARRAYS = {
    "vindex": (lambda m: indexing.vindex(m, creation.arange(m.spark, m.shape[0]), creation.arange(m.spark, m.shape[0]).map(lambda v: v % 64)), f"SELECT r AS i0, v FROM {_M} WHERE c = r % 64"),
    "oindex": (lambda m: indexing.oindex(m, [7, 3, 3], [1, 60]), f"SELECT k AS i0, j AS i1, v FROM {_M} JOIN (VALUES (0, 7), (1, 3), (2, 3)) a(k, p) ON p = r JOIN (VALUES (0, 1), (1, 60)) b(j, q) ON q = c"),
    "index_lists": (lambda m: m[[4, 1, 4], [0, 5, 63]], f"SELECT k AS i0, v FROM {_M} JOIN (VALUES (0, 4, 0), (1, 1, 5), (2, 4, 63)) t(k, p, q) ON p = r AND q = c"),
    "index_lists_apart": (lambda m: m.reshape(m.shape[0], 8, 8)[[2, 0], :, [1, 7]], f"SELECT k AS i0, c // 8 AS i1, v FROM {_M} JOIN (VALUES (0, 2, 1), (1, 0, 7)) t(k, p, q) ON p = r AND q = c % 8"),
    "take_along_axis": (lambda m: indexing.take_along_axis(m, lanes.argpartition(m, 10, 1), 1), f"SELECT r AS i0, k AS i1, v FROM {_ORDER}"),
    "argpartition": (lambda m: lanes.argpartition(m, 10, 1), f"SELECT r AS i0, k AS i1, c AS v FROM {_ORDER}"),
    "partition": (lambda m: lanes.partition(m, 10, 1), f"SELECT r AS i0, k AS i1, v FROM {_ORDER}"),
    "sort_complex": (lambda m: comparison.real(lanes.sort_complex(m)), f"SELECT row_number() OVER (ORDER BY v, r, c) - 1 AS i0, v FROM {_M}"),
    "put_along_axis": (lambda m: indexing.put_along_axis(m, (m.scan(F.max, F.greatest, 1) - m)[:, :1].map(lambda v: F.floor(v).cast("long") + 3, "int64"), 9.0, 1), f"SELECT r AS i0, c AS i1, CASE WHEN c = 3 THEN 9 ELSE v END AS v FROM {_M}"),
    "setitem_slice": (lambda m: indexing.assign(m, (slice(None), slice(0, 64, 2)), -1.0), f"SELECT r AS i0, c AS i1, CASE WHEN c % 2 = 0 THEN -1 ELSE v END AS v FROM {_M}"),
    "setitem_mask": (lambda m: indexing.assign(m, m > 0.1, 0.5), f"SELECT r AS i0, c AS i1, CASE WHEN v > 0.1 THEN 0.5 ELSE v END AS v FROM {_M}"),
    "setitem_row": (lambda m: indexing.assign(m, (slice(None, None, 3),), creation.arange(m.spark, 64.0)), f"SELECT r AS i0, c AS i1, CASE WHEN r % 3 = 0 THEN c ELSE v END AS v FROM {_M}"),
    "copyto": (lambda m: indexing.copyto(m, m.flip(1), m < 0), f"SELECT a.r AS i0, a.c AS i1, CASE WHEN a.v < 0 THEN b.v ELSE a.v END AS v FROM {_M} a JOIN {_M} b ON a.r = b.r AND b.c = 63 - a.c"),
    "putmask": (lambda m: indexing.putmask(m, m < 0, [1.0, 2.0, 3.0]), f"SELECT r AS i0, c AS i1, CASE WHEN v < 0 THEN 1 + (r * 64 + c) % 3 ELSE v END AS v FROM {_M}"),
    "place": (lambda m: indexing.place(m, m < 0, [1.0, 2.0, 3.0]), f"SELECT r AS i0, c AS i1, CASE WHEN v < 0 THEN 1 + (row_number() OVER (PARTITION BY v < 0 ORDER BY r, c) - 1) % 3 ELSE v END AS v FROM {_M}"),
    "fill_diagonal": (lambda m: indexing.fill_diagonal(m, 5), f"SELECT r AS i0, c AS i1, CASE WHEN r = c THEN 5 ELSE v END AS v FROM {_M}"),
    "fill": (lambda m: indexing.fill(m, 2.5), f"SELECT r AS i0, c AS i1, 2.5 AS v FROM {_M}"),
    "piecewise": (lambda m: indexing.piecewise(m, [(lambda v: v < 0, lambda v: -v), (lambda v: v > 0.2, lambda v: v * 10)]), f"SELECT r AS i0, c AS i1, CASE WHEN v > 0.2 THEN v * 10 WHEN v < 0 THEN -v ELSE 0 END AS v FROM {_M}"),
    "argwhere": (lambda m: indexing.argwhere(m > 0.2), f"SELECT n AS i0, k AS i1, CASE k WHEN 0 THEN r ELSE c END AS v FROM (SELECT row_number() OVER (ORDER BY r, c) - 1 AS n, r, c FROM {_M} WHERE v > 0.2), range(2) t(k)"),
    "flatnonzero": (lambda m: indexing.flatnonzero(m > 0.2), f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i0, r * 64 + c AS v FROM {_M} WHERE v > 0.2"),
    "unravel_index": (lambda m: indexing.unravel_index(NDFrame(m.df.withColumn("v", m.flat_index()), m.shape, "int64"), (m.shape[0], 8, 8))[1], f"SELECT r AS i0, c AS i1, c // 8 AS v FROM {_M}"),
    "ravel_multi_index": (lambda m: indexing.ravel_multi_index([_whole(m), _whole(m).flip(1)], (100, 50), "wrap"), f"SELECT a.r AS i0, a.c AS i1, ((CAST(floor(a.v * 100) AS BIGINT) % 100) + 100) % 100 * 50 + ((CAST(floor(b.v * 100) AS BIGINT) % 50) + 50) % 50 AS v FROM {_M} a JOIN {_M} b ON a.r = b.r AND b.c = 63 - a.c"),
    "extract": (lambda m: indexing.extract(m < -0.2, m), f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i0, v FROM {_M} WHERE v < -0.2"),
    "compress": (lambda m: indexing.compress([k % 3 == 1 for k in range(64)], m, 1), f"SELECT r AS i0, c // 3 AS i1, v FROM {_M} WHERE c % 3 = 1"),
    "tril_indices": (lambda m: indexing.tril_indices_from(m, -2)[1], f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i0, c AS v FROM {_M} WHERE c - r <= -2"),
    "triu_indices": (lambda m: indexing.triu_indices_from(m, 1)[0], f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i0, r AS v FROM {_M} WHERE c - r >= 1"),
    "mask_indices": (lambda m: indexing.mask_indices(m < 0)[1], f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i0, c AS v FROM {_M} WHERE v < 0"),
    "append": (lambda m: joining.append(m, m * 2, 1), f"SELECT r AS i0, c + 64 * k AS i1, v * (k + 1) AS v FROM {_M}, range(2) t(k)"),
    "broadcast_arrays": (lambda m: joining.broadcast_arrays(m, m[:, :1])[1], f"SELECT a.r AS i0, CAST(k AS BIGINT) AS i1, a.v FROM {_M} a, range(64) t(k) WHERE a.c = 0"),
    "rollaxis": (lambda m: joining.rollaxis(m.reshape(m.shape[0], 8, 8), 2), f"SELECT c % 8 AS i0, r AS i1, c // 8 AS i2, v FROM {_M}"),
    "moveaxis": (lambda m: m.reshape(m.shape[0], 8, 8).moveaxis(0, 2), f"SELECT c // 8 AS i0, c % 8 AS i1, r AS i2, v FROM {_M}"),
    "swapaxes": (lambda m: m.swapaxes(0, 1), f"SELECT c AS i0, r AS i1, v FROM {_M}"),
    "expand_squeeze": (lambda m: m.expand_dims(1).squeeze(), f"SELECT r AS i0, c AS i1, v FROM {_M}"),
    "fliplr": (lambda m: joining.fliplr(m), f"SELECT r AS i0, 63 - c AS i1, v FROM {_M}"),
    "flipud": (lambda m: joining.flipud(m), f"SELECT (SELECT max(vec_id) FROM embeddings) - r AS i0, c AS i1, v FROM {_M}"),
    "hsplit": (lambda m: joining.hsplit(m, 4)[2], f"SELECT r AS i0, c - 32 AS i1, v FROM {_M} WHERE c BETWEEN 32 AND 47"),
    "vsplit": (lambda m: joining.vsplit(m, [5, 9])[2], f"SELECT r - 9 AS i0, c AS i1, v FROM {_M} WHERE r >= 9"),
    "dsplit": (lambda m: joining.dsplit(m.reshape(m.shape[0], 8, 8), 2)[1], f"SELECT r AS i0, c // 8 AS i1, c % 8 - 4 AS i2, v FROM {_M} WHERE c % 8 >= 4"),
    "vstack": (lambda m: joining.vstack([m, -m]), f"SELECT r + k * (SELECT count(*) FROM embeddings) AS i0, c AS i1, CASE k WHEN 0 THEN v ELSE -v END AS v FROM {_M}, range(2) t(k)"),
    "hstack": (lambda m: joining.hstack([m, -m]), f"SELECT r AS i0, c + 64 * k AS i1, CASE k WHEN 0 THEN v ELSE -v END AS v FROM {_M}, range(2) t(k)"),
    "dstack": (lambda m: joining.dstack([m, -m]), f"SELECT r AS i0, c AS i1, CAST(k AS BIGINT) AS i2, CASE k WHEN 0 THEN v ELSE -v END AS v FROM {_M}, range(2) t(k)"),
    "matmul": (lambda m: contractions.matmul(m.T, m), f"SELECT a.c AS i0, b.c AS i1, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2"),
    "tensordot": (lambda m: contractions.tensordot(m, m, ([0], [0])), f"SELECT a.c AS i0, b.c AS i1, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2"),
    "inner": (lambda m: contractions.inner(m.T, m.T), f"SELECT a.c AS i0, b.c AS i1, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2"),
    "vecmat": (lambda m: contractions.vecmat(creation.arange(m.spark, float(m.shape[0])), m), f"SELECT c AS i0, sum(v * r) AS v FROM {_M} GROUP BY c"),
    "accumulate_maximum": (lambda m: lanes.accumulate(m, F.max, F.greatest, 1), f"SELECT r AS i0, c AS i1, max(v) OVER (PARTITION BY r ORDER BY c) AS v FROM {_M}"),
    "apply_over_axes": (lambda m: lanes.apply_over_axes(F.sum, m, [0, 1]), f"SELECT CAST(0 AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, sum(v) AS v FROM {_M}"),
    "convolve_full": (lambda m: lanes.convolve1d(m.ravel(), [0.5, 0.25, -1.0]), f"SELECT r * 64 + c + k AS i0, sum(v * w) AS v FROM {_M}, (VALUES (0, 0.5), (1, 0.25), (2, -1.0)) t(k, w) GROUP BY 1"),
    "correlate_valid": (lambda m: lanes.correlate(m.ravel(), [0.5, 0.25, -1.0]), f"SELECT i0, v FROM (SELECT r * 64 + c - k AS i0, sum(v * w) AS v, count(*) AS n FROM {_M}, (VALUES (0, 0.5), (1, 0.25), (2, -1.0)) t(k, w) GROUP BY 1) WHERE n = 3"),
    "reduceat_places": (lambda m: lanes.reduceat(m.ravel(), [0, 100, 50, 500], F.sum), f"SELECT CAST(k AS BIGINT) AS i0, sum(v) AS v FROM {_M} JOIN (VALUES (0, 0, 100), (1, 100, 101), (2, 50, 500), (3, 500, 1000000000)) t(k, a, b) ON r * 64 + c >= a AND r * 64 + c < b GROUP BY 1"),
    "at_add": (lambda m: lanes.at(m.ravel(), m.map(lambda v: F.lit(1.0)).df.select((F.col("i0") * 64).alias("i0"), "v"), F.sum, lambda a, b: a + b), f"SELECT r * 64 + c AS i0, v + CASE WHEN c = 0 THEN 64 ELSE 0 END AS v FROM {_M}"),
    "float32_sum": (lambda m: m.astype("float32").reduce(lambda v: F.sum(v.cast("double")), axis=1), f"SELECT r AS i0, sum(CAST(v AS FLOAT)::DOUBLE) AS v FROM {_M} GROUP BY r"),
    "uint8_add_wraps": (lambda m: (m * 1000).map(lambda v: F.floor(v).cast("long"), "int64").astype("uint8") + creation.full_like(m, 200, "uint8"), f"SELECT r AS i0, c AS i1, (((CAST(floor(v * 1000) AS BIGINT) % 256) + 256) % 256 + 200) % 256 AS v FROM {_M}"),
    "complex_sum": (lambda m: comparison.imag(_complex(m).reduce(lambda v: F.struct(F.sum(v["re"]).alias("re"), F.sum(v["im"]).alias("im")), axis=1)), f"SELECT r AS i0, sum(-2 * v) AS v FROM {_M} GROUP BY r"),
    "iscomplex": (lambda m: comparison.iscomplex(_complex(m)).astype("int64"), f"SELECT r AS i0, c AS i1, CAST(v <> 0 AS BIGINT) AS v FROM {_M}"),
    "real_if_close": (lambda m: comparison.real_if_close(m.astype("complex128")), f"SELECT r AS i0, c AS i1, v FROM {_M}"),
    "isclose": (lambda m: comparison.isclose(m, m + 1e-6).astype("int64"), f"SELECT r AS i0, c AS i1, CAST(abs(v - (v + 1e-6)) <= 1e-8 + 1e-5 * abs(v + 1e-6) AS BIGINT) AS v FROM {_M}"),
}


def _complex(m: NDFrame) -> NDFrame:
    """v - 2iv"""
    return NDFrame(m.df.withColumn("v", F.struct(F.col("v").alias("re"), (F.col("v") * -2).alias("im"))), m.shape, "complex128")


def _array(name: str, f, sql: str) -> None:
    places = [c for c in ("i0", "i1", "i2") if f"AS {c}" in sql or f"SELECT {c}," in sql]

    @_query(f"array_{name}", f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in places)}, round(CAST(v AS DOUBLE), 4) + 0.0 AS v FROM ({sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(f(_matrix(spark, sf_dir)), 4)


for _name, (_f, _sql) in ARRAYS.items():
    _array(_name, _f, _sql)


@_query("allclose", f"SELECT bool_and(abs(v - (v + 1e-9)) <= 1e-8 + 1e-5 * abs(v + 1e-9)) AS near, false AS far, true AS same, false AS other_shape, true AS equivalent FROM {_M}")
def allclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    rows = [(comparison.allclose(m, m + 1e-9), comparison.allclose(m, m + 0.1), comparison.array_equal(m, m.T.T), comparison.array_equal(m, m.T), comparison.array_equiv(creation.full_like(m, 1), creation.ones(spark, [1, 64])))]
    return spark.createDataFrame(rows, "near boolean, far boolean, same boolean, other_shape boolean, equivalent boolean")


@_query("ndenumerate", f"SELECT r * 64 + c AS pos, r AS i0, c AS i1, v FROM {_M}")
def ndenumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.ndenumerate(_matrix(spark, sf_dir))


@_query("ediff1d", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, v FROM (SELECT o_orderkey, round(coalesce(o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey), -1), 4) AS v FROM orders)")
def ediff1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.ediff1d(_table(spark, sf_dir, "orders"), ["o_orderkey"], "o_totalprice", [-1.0]).withColumn("v", F.round("v", 4))


#: name: (array, SQL), of as many places as there are suppliers
MADE = {
    "zeros_like": (lambda s, n: creation.zeros_like(creation.arange(s, n)), f"SELECT k AS i0, 0 AS v FROM range({_S}) t(k)"),
    "ones_like": (lambda s, n: creation.ones_like(creation.arange(s, float(n))), f"SELECT k AS i0, 1 AS v FROM range({_S}) t(k)"),
    "empty": (lambda s, n: creation.empty(s, [n]), f"SELECT k AS i0, 0 AS v FROM range({_S}) t(k)"),
    "identity": (lambda s, n: creation.identity(s, n), f"SELECT a AS i0, b AS i1, CAST(a = b AS INT) AS v FROM range({_S}) t(a), range({_S}) u(b)"),
    "diagflat": (lambda s, n: creation.diagflat(creation.arange(s, n), 1), f"SELECT a AS i0, b AS i1, CASE WHEN b = a + 1 THEN a ELSE 0 END AS v FROM range({_S} + 1) t(a), range({_S} + 1) u(b)"),
    "mgrid": (lambda s, n: creation.mgrid(s)[0:n, 0:1:5j][1], f"SELECT a AS i0, b AS i1, b / 4.0 AS v FROM range({_S}) t(a), range(5) u(b)"),
    "ogrid": (lambda s, n: creation.ogrid(s)[0:3, 10 : 10 + 5 * n : 5][1], f"SELECT 0 AS i0, b AS i1, 10 + 5 * b AS v FROM range({_S}) u(b)"),
    "r_": (lambda s, n: creation.r_(s)[0:n, 7, [5, 6]], f"SELECT k AS i0, CASE k - {_S} WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE k END AS v FROM range({_S} + 3) t(k)"),
    "c_": (lambda s, n: creation.c_(s)[0:n, 5 : 5 + n], f"SELECT a AS i0, b AS i1, a + 5 * b AS v FROM range({_S}) t(a), range(2) u(b)"),
    "fromfunction": (lambda s, n: creation.fromfunction(s, lambda a, b: a * 10 + b, [n, 4]), f"SELECT a AS i0, b AS i1, a * 10 + b AS v FROM range({_S}) t(a), range(4) u(b)"),
    "fromiter": (lambda s, n: creation.fromiter(s, (k * k for k in range(2 * n)), "int64", n), f"SELECT k AS i0, k * k AS v FROM range({_S}) t(k)"),
    "frombuffer": (lambda s, n: creation.frombuffer(s, bytes(range(16)) * n, "uint8", 4 * n, 2), f"SELECT k AS i0, (k + 2) % 16 AS v FROM range(4 * {_S}) t(k)"),
    "asarray_chkfinite": (lambda s, n: creation.asarray_chkfinite(s, [k / 2 for k in range(n)]), f"SELECT k AS i0, k / 2.0 AS v FROM range({_S}) t(k)"),
    "diag_indices": (lambda s, n: indexing.diag_indices(s, n)[1], f"SELECT k AS i0, k AS v FROM range({_S}) t(k)"),
}


def _made(name: str, f, sql: str) -> None:
    places = [c for c in ("i0", "i1") if f" {c}" in sql or f"({c}" in sql]

    @_query(f"create_{name}", f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in places)}, CAST(v AS DOUBLE) + 0.0 AS v FROM ({sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(f(spark, _suppliers(spark, sf_dir)), 6)


for _name, (_f, _sql) in MADE.items():
    _made(_name, _f, _sql)


@_query("dtype_limits", "SELECT * FROM (VALUES ('int8', -128.0::DOUBLE, 127.0::DOUBLE), ('uint16', 0.0, 65535.0), ('float32', -3.4028234663852886e38, 3.4028234663852886e38), ('float16', -65504.0, 65504.0)) t(name, low, high)")
def dtype_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda n: dtypes.iinfo(n) if dtypes.issubdtype(n, "integer") else dtypes.finfo(n)
    return spark.createDataFrame([(n, float(of(n).min), float(of(n).max)) for n in ("int8", "uint16", "float32", "float16")], "name string, low double, high double")


__all__ = ["ORACLE_SQL", "QUERIES"]
