"""Queries of long axes, files, selections, large systems and functions with signatures, over whole tables, and the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import NDFrame
from .functions import complexes as C
from .functions import polynomials
from .operators import aggregates as A
from .operators import comparison, contractions, creation, fourier, generalized, joining, lanes, quantiles, selection, sets, stacks, systems
from .operators.random import default_rng
from .plans.einsum import einsum
from .queries import _M, ORACLE_SQL, QUERIES, _matrix, _query, _rows, _table
from .sources import npy, text
from .storage import new_path, numbered


def _vector(spark: SparkSession, sf_dir: str, table: str, column: str, order: list[str]) -> NDFrame:
    """A whole column as one vector, in the order of other columns."""
    rows = numbered(_table(spark, sf_dir, table).select(*order, F.col(column).cast("double").alias("_v")), [F.col(c) for c in order], "i0")
    return NDFrame(rows.select("i0", F.col("_v").alias("v")), [rows.count()])


def _prices(spark: SparkSession, sf_dir: str) -> NDFrame:
    return _vector(spark, sf_dir, "orders", "o_totalprice", ["o_orderkey"])


_P = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CAST(o_totalprice AS DOUBLE) AS v FROM orders)"
_N = "(SELECT count(*) FROM orders)"
#: Frequencies at which SQL sums up all orders' prices.
_SOME = 24


def _spectrum(x: NDFrame) -> DataFrame:
    return x.df.filter(F.col("i0") < _SOME).select("i0", (F.round(F.col("v")["re"], 5) + 0.0).alias("re"), (F.round(F.col("v")["im"], 5) + 0.0).alias("im"))


_DFT = f"SELECT CAST(k AS BIGINT) AS i0, round(sum(v * cos(2 * pi() * ((k * i) % n) / n)) / any_value(n), 5) + 0.0 AS re, round(-sum(v * sin(2 * pi() * ((k * i) % n) / n)) / any_value(n), 5) + 0.0 AS im FROM {_P}, (SELECT {_N} AS n), range({_SOME}) t(k) GROUP BY k"


@_query("fft_whole_axis", _DFT)
def fft_whole_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest frequencies of all orders' prices, transformed as one vector."""
    return _spectrum(fourier.fft(_prices(spark, sf_dir), norm="forward"))


@_query("rfft_whole_axis", _DFT)
def rfft_whole_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(fourier.rfft(_prices(spark, sf_dir), norm="forward"))


@_query("ifft_whole_round_trip", f"SELECT i AS i0, round(v, 3) + 0.0 AS v FROM {_P}")
def ifft_whole_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(fourier.ifft(fourier.fft(_prices(spark, sf_dir))).map(lambda v: v["re"], "float64"), 3)


@_query("irfft_whole_round_trip", f"SELECT i AS i0, round(v, 3) + 0.0 AS v FROM {_P}")
def irfft_whole_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _prices(spark, sf_dir)
    return _rows(fourier.irfft(fourier.rfft(x), x.shape[0]), 3)


@_query("fft2_energy", f"SELECT round(sum(v * v), 3) AS v FROM {_M}")
def fft2_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of all frequencies of the embeddings' matrix sum to those of its elements."""
    both = fourier.fft2(_matrix(spark, sf_dir), norm="ortho")
    return both.df.agg(F.round(F.sum(F.col("v")["re"] * F.col("v")["re"] + F.col("v")["im"] * F.col("v")["im"]), 3).alias("v"))


@_query("hfft", f"SELECT r AS i0, CAST(k AS BIGINT) AS i1, round(any_value(v) FILTER (c = 0) + any_value(v) FILTER (c = 63) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END + 2 * sum(v * cos(2 * pi() * k * c / 126)) FILTER (c BETWEEN 1 AND 62), 4) + 0.0 AS v FROM {_M}, range(126) t(k) GROUP BY r, k")
def hfft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(fourier.hfft(_matrix(spark, sf_dir)), 4)


@_query("convolve_with_table", f"SELECT i AS i0, round(sum(v * w), 3) + 0.0 AS v FROM (SELECT a.i + b.k AS i, a.v, b.w FROM {_P} a, (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS k, c_acctbal / 1e4 AS w FROM customer) b WHERE a.i + b.k < 400) GROUP BY i")
def convolve_with_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders' prices convolved with all customers' balances; the first places, which SQL can sum up."""
    kernel = _vector(spark, sf_dir, "customer", "c_acctbal", ["c_custkey"]).map(lambda v: v / 1e4)
    out = lanes.convolve1d(_prices(spark, sf_dir), kernel)
    return _rows(NDFrame(out.df.filter("i0 < 400"), [400]), 3)


@_query("convolve_total", f"SELECT {_N} + (SELECT count(*) FROM customer) - 1 AS n, round((SELECT sum(v) FROM {_P}) * (SELECT sum(c_acctbal) FROM customer) / 1e12, 4) AS total")
def convolve_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of that convolution sum to the product of both sums."""
    out = lanes.convolve1d(_prices(spark, sf_dir), _vector(spark, sf_dir, "customer", "c_acctbal", ["c_custkey"]))
    return out.df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v") / 1e12, 4).alias("total"))


_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
_Q = f"(SELECT row_number() OVER (ORDER BY {', '.join(_LINES)}) - 1 AS i, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)"
_SPLIT = f"(SELECT i, v, CASE WHEN v < p THEN 0 WHEN v = p THEN 1 ELSE 2 END AS class FROM {_Q}, (SELECT v AS p FROM {_Q} ORDER BY v LIMIT 1 OFFSET 20000))"


def _lines(spark: SparkSession, sf_dir: str) -> NDFrame:
    return _vector(spark, sf_dir, "lineitem", "l_extendedprice", _LINES)


@_query("partition_whole_axis", f"SELECT row_number() OVER (ORDER BY class, i) - 1 AS i0, v FROM {_SPLIT}")
def partition_whole_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items around the 20,000th price: each class in the order it had."""
    return selection.arranged(_lines(spark, sf_dir), 20_000).df.select("i0", "v")


@_query("argpartition_whole_axis", f"SELECT row_number() OVER (ORDER BY class, i) - 1 AS i0, i AS v FROM {_SPLIT}")
def argpartition_whole_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.arranged(_lines(spark, sf_dir), 20_000).df.select("i0", F.col("_from").alias("v"))


# Files that tasks write and read


@_query("save_round_trip", f"SELECT r AS i0, c AS i1, v FROM {_M}")
def save_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "saved") + ".npy"
    npy.save(_matrix(spark, sf_dir).astype("float64"), path)
    return npy.load(spark, path).df


@_query("savez_round_trip", f"SELECT r AS i0, c AS i1, v * 2 AS v FROM {_M}")
def savez_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, m = new_path(spark, "saved") + ".npz", _matrix(spark, sf_dir).astype("float64")
    npy.savez(path, one=m, two=m * 2)
    return npy.NpzFile(spark, path)["two"].df


@_query("savez_compressed_round_trip", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, o_custkey AS v FROM orders")
def savez_compressed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "saved") + ".npz"
    npy.savez_compressed(path, prices=_prices(spark, sf_dir), customers=_vector(spark, sf_dir, "orders", "o_custkey", ["o_orderkey"]).astype("int64"))
    return npy.load(spark, path, "customers").df


@_query("tofile_round_trip", f"SELECT i AS i0, v FROM {_P}")
def tofile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "saved") + ".bin"
    npy.tofile(_prices(spark, sf_dir), path)
    return npy.fromfile(spark, path).df


@_query("savetxt_round_trip", f"SELECT r AS i0, c AS i1, round(v, 6) + 0.0 AS v FROM {_M}")
def savetxt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "saved")
    text.savetxt(_matrix(spark, sf_dir).astype("float64"), path, "%.12e")
    return _rows(text.loadtxt(spark, path), 6)


# Linear algebra of whole tables


@_query("svd_tall_sums", f"WITH g AS (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2) SELECT round(sum(v) FILTER (i = j), 3) AS squares, round(sum(v * v), 1) AS fourth FROM g")
def svd_tall_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of singular values sum to the Gram matrix' trace, fourth powers to the squares of its elements."""
    _, s, _ = systems.svd_tall(_table(spark, sf_dir, "embeddings"), "embedding", 64, "vec_id")
    return spark.createDataFrame([(float((s**2).sum()), float((s**4).sum()))], "squares double, fourth double").select(F.round("squares", 3).alias("squares"), F.round("fourth", 1).alias("fourth"))


@_query("svd_tall_rebuilt", f"SELECT r AS vec_id, CAST(c AS INTEGER) AS place, round(v, 5) + 0.0 AS v FROM {_M}")
def svd_tall_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U times s times V^H, row by row."""
    u, s, vh = systems.svd_tall(_table(spark, sf_dir, "embeddings"), "embedding", 64, "vec_id")
    back = F.array(*(F.array(*map(F.lit, column)) for column in (s[:, None] * vh).T.tolist()))
    row = F.transform(back, lambda c: F.round(F.aggregate(F.zip_with("u", c, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v), 5) + 0.0)
    return u.select("vec_id", F.posexplode(row).alias("place", "v"))


def _kernel(spark: SparkSession, sf_dir: str) -> NDFrame:
    """The products of all embeddings with each other, and 40 more on the diagonal: as many equations as embeddings."""
    m = _matrix(spark, sf_dir)
    k = contractions.blocked_matmul(m, m.T)
    return k.map(lambda v: v + F.when(F.col("i0") == F.col("i1"), 40.0).otherwise(0.0))


@_query("linalg_solve_panels", "SELECT vec_id AS i0, round(CAST(vec_id % 7 - 3 AS DOUBLE), 4) + 0.0 AS v FROM embeddings")
def linalg_solve_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side is the matrix times a known vector, which comes back."""
    a = _kernel(spark, sf_dir)
    known = NDFrame(spark.range(a.shape[0]).select(F.col("id").alias("i0"), (F.col("id") % 7 - 3).cast("double").alias("v")), [a.shape[0]])
    return _rows(systems.solve_panels(a, contractions.matvec(a, known), 128), 4)


@_query("linalg_tensorsolve", "SELECT CAST(i // 8 AS BIGINT) AS i0, CAST(i % 8 AS BIGINT) AS i1, round(CAST(i % 5 - 2 AS DOUBLE), 4) + 0.0 AS v FROM range(64) t(i)")
def linalg_tensorsolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = contractions.gram(_table(spark, sf_dir, "embeddings"), "embedding", 64)
    g = g.map(lambda v: v + F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0))
    known = NDFrame(spark.range(64).select(F.col("id").alias("i0"), (F.col("id") % 5 - 2).cast("double").alias("v")), [64])
    return _rows(systems.tensorsolve(g.reshape(8, 8, 8, 8), contractions.matvec(g, known).reshape(8, 8)), 4)


def _stack(spark: SparkSession, sf_dir: str) -> NDFrame:
    """Every embedding as a matrix of 8 x 8."""
    m = _matrix(spark, sf_dir).astype("float64")
    return m.reshape(m.shape[0], 8, 8)


@_query("linalg_eigvalsh_sums", f"SELECT i0, round(sum(v) FILTER (i = j), 4) + 0.0 AS total, round(sum(v * v), 4) AS squares FROM (SELECT a.r AS i0, a.c // 8 AS i, b.c // 8 AS j, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.r = b.r AND a.c % 8 = b.c % 8 GROUP BY 1, 2, 3) GROUP BY i0")
def linalg_eigvalsh_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of M M^T of every embedding's matrix: their sum and the sum of their squares."""
    m = _stack(spark, sf_dir)
    w = stacks.eigvalsh(contractions.matmul(m, m.swapaxes(1, 2)))
    return w.df.groupBy("i0").agg((F.round(F.sum("v"), 4) + 0.0).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 4).alias("squares"))


@_query("linalg_svd_rebuilt", f"SELECT r AS i0, c // 8 AS i1, c % 8 AS i2, round(v, 5) + 0.0 AS v FROM {_M}")
def linalg_svd_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, s, vh = stacks.svd(_stack(spark, sf_dir))
    return _rows(contractions.matmul(u * s.expand_dims(1), vh))


@_query("linalg_qr_rebuilt", f"SELECT r AS i0, c // 8 AS i1, c % 8 AS i2, round(v, 5) + 0.0 AS v FROM {_M}")
def linalg_qr_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(contractions.matmul(*stacks.qr(_stack(spark, sf_dir))))


@_query("linalg_eigh_rebuilt", f"SELECT a.r AS i0, a.c // 8 AS i1, a.c % 8 AS i2, round(a.v + b.v, 5) + 0.0 AS v FROM {_M} a JOIN {_M} b ON a.r = b.r AND b.c = a.c % 8 * 8 + a.c // 8")
def linalg_eigh_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _stack(spark, sf_dir)
    w, e = stacks.eigh(m + m.swapaxes(1, 2))
    return _rows(contractions.matmul(e * w.expand_dims(1), e.swapaxes(1, 2)))


@_query("linalg_pinv_projects", f"SELECT r AS i0, c // 8 AS i1, c % 8 AS i2, round(v, 4) + 0.0 AS v FROM {_M}")
def linalg_pinv_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix times its pseudoinverse times itself is itself."""
    m = _stack(spark, sf_dir)
    return _rows(contractions.matmul(contractions.matmul(m, stacks.pinv(m)), m), 4)


# Functions of cells


@_query("gufunc_quadratic", f"SELECT a.r AS i0, CAST(k AS BIGINT) AS i1, round(sum(a.v * b.v * c.v), 5) + 0.0 AS v FROM {_M} a JOIN {_M} b ON a.r = b.r AND b.c = a.c // 8 JOIN {_M} c ON a.r = c.r AND c.c = a.c % 8, range(1) t(k) GROUP BY 1, 2")
def gufunc_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x^T M x of every embedding's matrix and its first row, which has an axis of one place more."""
    m = _stack(spark, sf_dir)
    f = generalized.gufunc(lambda a, x: np.einsum("bmn,bm,bn->b", a, x, x), "(m,m),(m)->()")
    return _rows(f(m.expand_dims(1), m[:, :1, :]))


@_query("vectorize_orders", f"SELECT i AS i0, CAST(CASE WHEN v > 200000 THEN 2 WHEN v > 100000 THEN 1 ELSE 0 END AS BIGINT) AS v FROM {_P}")
def vectorize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = generalized.vectorize(lambda p: 2 if p > 200_000 else 1 if p > 100_000 else 0, "int64")
    return grade(_prices(spark, sf_dir)).df


@_query("apply_along_axis", f"SELECT r AS i0, CAST(k AS BIGINT) AS i1, round(CASE k WHEN 0 THEN min(v) ELSE max(v) END, 6) + 0.0 AS v FROM {_M}, range(2) t(k) GROUP BY r, k")
def apply_along_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(generalized.apply_along_axis(lambda v: np.array([v.min(), v.max()]), 1, _matrix(spark, sf_dir)), 6)


def _z(m: NDFrame) -> NDFrame:
    """v + i v (c + 1)"""
    return NDFrame(m.df.withColumn("v", C.make(F.col("v").cast("double"), F.col("v") * (F.col("i1") + 1))), m.shape, "complex128")


_PAIRS = f"SELECT a.c AS i0, b.c AS i1, a.v * b.v AS p FROM {_M} a JOIN {_M} b ON a.r = b.r"


@_query("einsum_complex", f"SELECT i0, i1, round(sum(p * (1 - (i0 + 1) * (i1 + 1))), 2) + 0.0 AS re, round(sum(p * (i0 + i1 + 2)), 2) + 0.0 AS im FROM ({_PAIRS}) GROUP BY 1, 2")
def einsum_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _z(_matrix(spark, sf_dir))
    return einsum("ri,rj->ij", z, z).df.select("i0", "i1", (F.round(F.col("v")["re"], 2) + 0.0).alias("re"), (F.round(F.col("v")["im"], 2) + 0.0).alias("im"))


@_query("vecdot_complex", f"SELECT r AS i0, round(sum(v * v * (1 + (c + 1) * (c + 1))), 3) + 0.0 AS v FROM {_M} GROUP BY r")
def vecdot_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of absolute values, as one side is conjugated."""
    z = _z(_matrix(spark, sf_dir))
    return _rows(contractions.vecdot(z, z).map(lambda v: v["re"], "float64"), 3)


# Lanes, groups and sets that the other modules have no query of


@_query("lane_unwrap", "WITH s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), m AS (SELECT *, d + 25 - 50 * floor((d + 25) / 50) - 25 AS r FROM s) SELECT event_id, round(value + sum(CASE WHEN d IS NULL OR abs(d) < 25 THEN 0 ELSE CASE WHEN r = -25 AND d > 0 THEN 25 ELSE r END - d END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS unwrapped FROM m")
def lane_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lanes.unwrap(_table(spark, sf_dir, "events"), ["user_id"], ["ts"], "value", 50.0)
    return out.select("event_id", (F.round("unwrapped", 4) + 0.0).alias("unwrapped"))


@_query("reduce_nanargmax", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) FILTER (o_orderkey % 3 <> 0) AS largest, arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) FILTER (o_orderkey % 3 <> 0) AS least FROM orders GROUP BY o_custkey")
def reduce_nanargmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 3 == 0, float("nan")).otherwise(F.col("o_totalprice")))
    return orders.groupBy("o_custkey").agg(A.nanargmax("p", "o_orderkey").alias("largest"), A.nanargmin("p", "o_orderkey").alias("least"))


@_query("nanquantile", "SELECT o_orderpriority, CAST(0.3 AS DOUBLE) AS q, round(quantile_cont(o_totalprice, 0.3), 4) AS quantile FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def nanquantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("p"))
    return quantiles.quantiles(orders, ["o_orderpriority"], "p", [0.3], ignore_nan=True).withColumn("quantile", F.round("quantile", 4))


@_query("unique_all", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, min(p_partkey) OVER (PARTITION BY p_size) AS first_index, dense_rank() OVER (ORDER BY p_size) - 1 AS inverse, count(*) OVER (PARTITION BY p_size) AS count FROM part")
def unique_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.unique_all(_table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_size", "p_partkey")


@_query("unique_values", "SELECT DISTINCT p_size AS value FROM part")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.unique_values(_table(spark, sf_dir, "part"), "p_size")


@_query("random_permutation", "SELECT count(*) AS n, true AS every_place, true AS mixed FROM orders")
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place is taken once, and few orders keep theirs."""
    out = default_rng(spark, 3).permutation(numbered(_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "was"), "pos")
    n = F.count(F.lit(1))
    return out.agg(n.alias("n"), ((F.count_distinct("pos") == n) & (F.max("pos") == n - 1)).alias("every_place"), (F.count_if(F.col("pos") == F.col("was")) < 30).alias("mixed"))


@_query("random_choice", "SELECT count(*) // 10 AS n, true AS apart, true AS fair FROM orders")
def random_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders, none twice, with a mean price near that of all."""
    orders = _table(spark, sf_dir, "orders")
    n, mean, deviation = orders.agg(F.count(F.lit(1)), F.avg("o_totalprice"), F.stddev("o_totalprice")).first()
    out = default_rng(spark, 4).choice(orders.select("o_orderkey", "o_totalprice"), n // 10)
    return out.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("o_orderkey") == F.count(F.lit(1))).alias("apart"), (F.abs(F.avg("o_totalprice") - mean) < 6 * deviation / (n // 10) ** 0.5).alias("fair"))


@_query("genfromtxt_orders", "SELECT dense_rank() OVER (ORDER BY o_orderkey) - 1 AS i0, CAST(k AS BIGINT) AS i1, CASE WHEN k = 0 THEN CAST(o_custkey AS DOUBLE) WHEN o_custkey % 2 = 1 THEN -1.0 ELSE round(CAST(o_totalprice AS DOUBLE), 2) END AS v FROM orders, range(2) t(k)")
def genfromtxt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of customers and prices, every other price missing, written and read back."""
    rows = numbered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])
    path = new_path(spark, "lines")
    line = F.concat_ws(",", F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 2 == 1, "none").otherwise(F.format_string("%.2f", "o_totalprice")))
    rows.repartitionByRange("pos").sortWithinPartitions("pos").select(line).write.text(path)
    return text.genfromtxt(spark, path, ",", missing_values=("none",), filling_values=-1.0).df


# Operators that the other modules have no query of

MORE = {
    "cross": (lambda m: contractions.cross(m[:, 0:3], m[:, 3:6]), f"SELECT r AS i0, k AS i1, (max(v) FILTER (c = (k + 1) % 3)) * (max(v) FILTER (c = 3 + (k + 2) % 3)) - (max(v) FILTER (c = (k + 2) % 3)) * (max(v) FILTER (c = 3 + (k + 1) % 3)) AS v FROM {_M}, range(3) t(k) GROUP BY r, k"),
    "multi_dot": (lambda m: contractions.multi_dot(m.T, m, m.T), f"SELECT g.i AS i0, x.r AS i1, sum(g.v * x.v) AS v FROM (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2) g JOIN {_M} x ON x.c = g.j GROUP BY 1, 2"),
    "broadcast_to": (lambda m: m[:, :1].broadcast_to([m.shape[0], 5]), f"SELECT r AS i0, k AS i1, v FROM {_M}, range(5) t(k) WHERE c = 0"),
    "array_split": (lambda m: joining.array_split(m, 5, 1)[4], f"SELECT r AS i0, c - 52 AS i1, v FROM {_M} WHERE c >= 52"),
    "trapezoid_rows": (lambda m: (m[:, 1:] + m[:, :-1]).reduce(F.sum, axis=1).map(lambda v: v / 2), f"SELECT r AS i0, sum(v) - (max(v) FILTER (c = 0) + max(v) FILTER (c = 63)) / 2 AS v FROM {_M} GROUP BY r"),
    "resize": (lambda m: joining.resize(m, [m.shape[0], 32]), f"SELECT (r * 64 + c) // 32 AS i0, (r * 64 + c) % 32 AS i1, v FROM {_M} WHERE r * 64 + c < 32 * (SELECT count(*) FROM embeddings)"),
    "split": (lambda m: joining.split(m, 4, 1)[3], f"SELECT r AS i0, c - 48 AS i1, v FROM {_M} WHERE c >= 48"),
    "unstack": (lambda m: joining.unstack(m, 1)[5], f"SELECT r AS i0, v FROM {_M} WHERE c = 5"),
    "block": (lambda m: joining.block([[m[:, :2], m[:, 2:4]], [m[:, 4:6], m[:, 6:8]]]), f"SELECT r + CASE WHEN c < 4 THEN 0 ELSE (SELECT count(*) FROM embeddings) END AS i0, c % 4 AS i1, v FROM {_M} WHERE c < 8"),
    "column_stack": (lambda m: joining.column_stack([m[:, 0], m[:, 3]]), f"SELECT r AS i0, c // 3 AS i1, v FROM {_M} WHERE c IN (0, 3)"),
    "atleast_3d": (lambda m: joining.atleast(m, 3)[:, :, 0], f"SELECT r AS i0, c AS i1, v FROM {_M}"),
    "packbits": (lambda m: joining.packbits((m > 0).ravel()), f"SELECT (r * 64 + c) // 8 AS i0, sum(CASE WHEN v > 0 THEN 1 << CAST(7 - c % 8 AS INTEGER) ELSE 0 END) AS v FROM {_M} GROUP BY 1"),
    "unpackbits": (lambda m: joining.unpackbits(joining.packbits((m > 0).ravel())), f"SELECT r * 64 + c AS i0, CAST(v > 0 AS INTEGER) AS v FROM {_M}"),
    "trim_zeros": (lambda m: joining.trim_zeros(m.ravel().map(lambda v: F.when(v > 0.25, v).otherwise(0.0), "float64")), f"SELECT p - (SELECT min(r * 64 + c) FROM {_M} WHERE v > 0.25) AS i0, CASE WHEN v > 0.25 THEN v ELSE 0 END AS v FROM (SELECT r * 64 + c AS p, v FROM {_M}) WHERE p BETWEEN (SELECT min(r * 64 + c) FROM {_M} WHERE v > 0.25) AND (SELECT max(r * 64 + c) FROM {_M} WHERE v > 0.25)"),
    "ifftshift": (lambda m: stacks.ifftshift(m, 1), f"SELECT r AS i0, (c + 32) % 64 AS i1, v FROM {_M}"),
    "dot": (lambda m: contractions.dot(m.T, m), f"SELECT a.c AS i0, b.c AS i1, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.r = b.r GROUP BY 1, 2"),
    "vdot": (lambda m: contractions.vdot(m, m), f"SELECT sum(v * v) AS v FROM {_M}"),
    "diag": (lambda m: creation.diag(m.reduce(F.avg, axis=0)), f"SELECT a AS i0, b AS i1, CASE WHEN a = b THEN (SELECT avg(v) FROM {_M} WHERE c = a) ELSE 0 END AS v FROM range(64) t(a), range(64) u(b)"),
    "put": (lambda m: m.put({0: 9.0, 65: -1.0}), f"SELECT r AS i0, c AS i1, CASE r * 64 + c WHEN 0 THEN 9 WHEN 65 THEN -1 ELSE v END AS v FROM {_M}"),
    "isreal": (lambda m: comparison.isreal(_z(m)).astype("int64"), f"SELECT r AS i0, c AS i1, CAST(v = 0 AS INTEGER) AS v FROM {_M}"),
    "polynomial": (lambda m: polynomials.Polynomial([1.0, 2.0, 3.0], "chebyshev").evaluate_array(m), f"SELECT r AS i0, c AS i1, 1 + 2 * v + 3 * (2 * v * v - 1) AS v FROM {_M}"),
    "norm_columns": (lambda m: stacks.norm(m, 1, 0), f"SELECT c AS i0, sum(abs(v)) AS v FROM {_M} GROUP BY c"),
    "norm_whole": (lambda m: stacks.norm(m), f"SELECT sqrt(sum(v * v)) AS v FROM {_M}"),
    "norm_matrices": (lambda m: stacks.norm(m.astype("float64").reshape(m.shape[0], 8, 8), float("inf"), (1, 2)), f"SELECT r AS i0, max(s) AS v FROM (SELECT r, c // 8 AS k, sum(abs(v)) AS s FROM {_M} GROUP BY 1, 2) GROUP BY r"),
    "copy": (lambda m: creation.copy(m), f"SELECT r AS i0, c AS i1, v FROM {_M}"),
    "full_like": (lambda m: creation.full_like(m, 2.5), f"SELECT r AS i0, c AS i1, 2.5 AS v FROM {_M}"),
    "indices": (lambda m: creation.indices(m.spark, m.shape)[1], f"SELECT r AS i0, c AS i1, c AS v FROM {_M}"),
    "zeros": (lambda m: creation.zeros(m.spark, m.shape), f"SELECT r AS i0, c AS i1, 0 AS v FROM {_M}"),
    "ones": (lambda m: creation.ones(m.spark, m.shape), f"SELECT r AS i0, c AS i1, 1 AS v FROM {_M}"),
    "full": (lambda m: creation.full(m.spark, m.shape, -2.0), f"SELECT r AS i0, c AS i1, -2 AS v FROM {_M}"),
    "rfftfreq": (lambda m: creation.rfftfreq(m.spark, m.shape[0]), "SELECT k AS i0, k * 1.0 / (SELECT count(*) FROM embeddings) AS v FROM range((SELECT count(*) // 2 + 1 FROM embeddings)) t(k)"),
    "norm_order_3": (lambda m: m.reduce(lambda v: A.vector_norm(v, 3), axis=1), f"SELECT r AS i0, pow(sum(pow(abs(v), 3)), 1.0 / 3) AS v FROM {_M} GROUP BY r"),
}


def _more(name: str, f, sql: str) -> None:
    places = [c for c in ("i0", "i1") if f"AS {c}" in sql]

    @_query(f"array_{name}", f"SELECT {''.join(f'CAST({c} AS BIGINT) AS {c}, ' for c in places)}round(CAST(v AS DOUBLE), 3) + 0.0 AS v FROM ({sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(f(_matrix(spark, sf_dir)), 3)


for _name, (_f, _sql) in MORE.items():
    _more(_name, _f, _sql)

__all__ = ["ORACLE_SQL", "QUERIES"]
