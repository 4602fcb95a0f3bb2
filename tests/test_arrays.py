"""Arrays against numpy."""

import itertools
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe import dtypes, queries
from axisframe.frame import AxisError, NDFrame, broadcast_shapes
from axisframe.functions import complexes as C
from axisframe.functions import polynomials
from axisframe.functions import real as R
from axisframe.operators import contractions, creation, histograms, joining, lanes, quantiles, sets, stacks
from axisframe.operators.random import default_rng
from axisframe.plans.einsum import einsum, einsum_path
from axisframe.sources import npy, text
from axisframe.storage import numbered

EDGES = [0.0, -0.0, math.inf, -math.inf, math.nan, 1.0, -1.0, 2.5, -2.5, 1e308, 5e-324]


def same(got, want):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=1e-12, atol=1e-300)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(itertools.product(EDGES, EDGES))]
    return spark.createDataFrame(rows, "k int, a double, b double").coalesce(1).persist()


BINARY = {
    "divide": np.divide, "floor_divide": np.floor_divide, "remainder": np.remainder, "fmod": np.fmod, "power": np.power, "copysign": np.copysign, "heaviside": np.heaviside,
    "maximum": np.maximum, "minimum": np.minimum, "fmax": np.fmax, "fmin": np.fmin, "arctan2": np.arctan2, "nextafter": np.nextafter,
    "less": np.less, "less_equal": np.less_equal, "equal": np.equal, "not_equal": np.not_equal, "greater": np.greater, "greater_equal": np.greater_equal, "isclose": np.isclose,
    "logical_and": np.logical_and, "logical_xor": np.logical_xor,
}


def test_binary_functions_on_special_values(grid):
    got = grid.select("k", "a", "b", *(getattr(R, n)(F.col("a"), F.col("b")).alias(n) for n in BINARY)).toPandas().sort_values("k")
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    for name, f in BINARY.items():
        with np.errstate(all="ignore"):
            want = f(a, b)
        assert not got[name].isna().sum() > np.isnan(want.astype(float)).sum(), name
        same(got[name], want)


UNARY = {
    "sign": np.sign, "floor": np.floor, "ceil": np.ceil, "trunc": np.trunc, "rint": np.rint, "log": np.log, "log2": np.log2, "log10": np.log10, "log1p": np.log1p, "signbit": np.signbit,
    "reciprocal": np.reciprocal, "square": np.square, "isinf": np.isinf, "isfinite": np.isfinite, "isposinf": np.isposinf, "isneginf": np.isneginf, "spacing": np.spacing, "nan_to_num": np.nan_to_num,
}


def test_unary_functions_on_special_values(grid):
    rows = grid.select("k", "a", *(getattr(R, n)(F.col("a")).alias(n) for n in UNARY)).filter("k % 11 = 0").toPandas().sort_values("k")
    for name, f in UNARY.items():
        with np.errstate(all="ignore"):
            same(rows[name], f(rows["a"].to_numpy()))


def test_power_gives_the_nearest_float(spark):
    bases = [abs((150000.0 - price) / 50000.0) for price in (149999.99, 149999.9, 140000.07, 123456.78, 333333.33)]
    pairs = [(a, float(b)) for a in bases for b in (-3, -2, 2, 3)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate([*pairs, (None, 0.0), (math.nan, 1.0)])], "k int, a double, b double")
    got = [r[0] for r in df.select(R.power(F.col("a"), F.col("b")).alias("v"), "k").orderBy("k").collect()]
    assert got[: len(pairs)] == [float(Fraction(a) ** int(b)) for a, b in pairs]
    assert got[-2] is None and math.isnan(got[-1])


def test_values_of_queries_are_rounded_as_sql_rounds(spark):
    values = [7.647990249999999, -13.842120249999999, 528685630858.6225, 24999999953433.867, 0.00000005, -0.00000001, -0.0, 1e300, 1.7e308, math.inf, -math.inf, math.nan]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select(queries._near(F.col("v")), "k").orderBy("k").collect()
    want = duckdb.execute("SELECT round(v, 7) + 0.0 FROM (SELECT unnest(?) AS v)", [values]).fetchall()
    assert [repr(r[0]) for r in got] == [repr(w[0]) for w in want]


def test_whole_numbers_wrap(spark):
    top, low = 2**63 - 1, -(2**63)
    pairs = [(top, 1), (low, -1), (low, 1), (top, top), (low, low), (7, -3), (-7, 3), (5, 0), (123456789012, 987654321098), (-3, 2**62)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a long, b long")
    names = ["int_add", "int_subtract", "int_multiply", "int_floor_divide", "int_remainder", "int_fmod"]
    got = df.select("k", *(getattr(R, n)(F.col("a"), F.col("b")).alias(n) for n in names), R.int_power(F.col("a"), 3).alias("cube"), R.gcd(F.col("a") % 1000, F.col("b") % 1000).alias("gcd")).orderBy("k").collect()
    a, b = (np.array(x, np.int64) for x in zip(*pairs))
    with np.errstate(all="ignore"):
        want = [a + b, a - b, a * b, np.floor_divide(a, b), np.remainder(a, b), np.fmod(a, b), a**3]
    for name, w in zip([*names, "cube"], want):
        assert [r[name] for r in got] == w.tolist(), name
    small = R.int_multiply(F.lit(100).cast("tinyint"), F.lit(3).cast("tinyint"), dtypes.dtype("int8"))
    assert spark.range(1).select(small.alias("v")).first()["v"] == np.int8(300 - 256)


def test_promotion_and_casts(spark):
    names = [n for n in dtypes.DTYPES]
    for a, b in itertools.product(names, names):
        assert dtypes.promote(a, b).name == np.promote_types(a, b).name, (a, b)
    assert dtypes.result_type("float32", 1.5).name == "float32"
    assert dtypes.result_type("int8", 2.0).name == "float64"
    x = spark.createDataFrame([(float(v),) for v in (1.9, -1.9, 1e20, -1e20, math.nan)], "v double")
    got = [r[0] for r in x.select(dtypes.cast(F.col("v"), "float64", "int64")).collect()]
    assert got == [1, -1, 2**63 - 1, -(2**63), 0]


def test_complex(spark):
    z = [(1 + 2j, 3 - 1j), (2j, 4 + 0j), (-1 + 0j, 0.5 + 0.5j)]
    df = spark.createDataFrame([({"re": a.real, "im": a.imag}, {"re": b.real, "im": b.imag}) for a, b in z], "a struct<re:double,im:double>, b struct<re:double,im:double>")
    for f, g in ((C.multiply, np.multiply), (C.divide, np.divide), (C.add, np.add), (C.power, np.power)):
        got = [complex(r[0]["re"], r[0]["im"]) for r in df.select(f(F.col("a"), F.col("b"))).collect()]
        np.testing.assert_allclose(got, [g(a, b) for a, b in z], rtol=1e-9, atol=1e-12)
    for f, g in ((C.sqrt, np.sqrt), (C.exp, np.exp), (C.log, np.log)):
        got = [complex(r[0]["re"], r[0]["im"]) for r in df.select(f(F.col("a"))).collect()]
        np.testing.assert_allclose(got, [g(a) for a, _ in z], rtol=1e-9, atol=1e-12)


@pytest.fixture(scope="module")
def cube(spark):
    a = np.arange(24.0).reshape(2, 3, 4) % 7 - 2
    return creation.array(spark, a), a


SHAPES = [
    lambda x: x.reshape(4, 6), lambda x: x.reshape(-1, 2), lambda x: x.transpose(2, 0, 1), lambda x: x.swapaxes(0, 2), lambda x: x.ravel(),
]


def test_shapes(cube):
    x, a = cube
    for f in SHAPES:
        same(f(x).to_numpy(), f(a))
    same(x.flip(1).to_numpy(), np.flip(a, 1))
    same(x.roll(2, 2).to_numpy(), np.roll(a, 2, 2))
    same(x.rot90().to_numpy(), np.rot90(a))
    same(x.repeat(2, 1).to_numpy(), np.repeat(a, 2, 1))
    same(x.tile((2, 1, 2)).to_numpy(), np.tile(a, (2, 1, 2)))
    same(x.moveaxis(0, 2).to_numpy(), np.moveaxis(a, 0, 2))
    same(x.expand_dims(1).squeeze(1).to_numpy(), a)


INDICES = [np.s_[1], np.s_[:, 1:3], np.s_[..., ::-1], np.s_[0, :, ::2], np.s_[:, None, 2], np.s_[-1, ..., -1], np.s_[:, [2, 0, 2]], np.s_[1:1], np.s_[:, ::-2, 1]]


@pytest.mark.parametrize("k", range(len(INDICES)))
def test_indexing(cube, k):
    x, a = cube
    got = x[INDICES[k]]
    assert got.shape == a[INDICES[k]].shape
    same(got.to_numpy(), a[INDICES[k]])


def test_masks_and_errors(cube):
    x, a = cube
    same(x[x > 1].to_numpy(), a[a > 1])
    with pytest.raises(IndexError):
        x[5]
    with pytest.raises(AxisError):
        x.flip(3)
    with pytest.raises(ValueError):
        x.reshape(5, 5)
    assert broadcast_shapes((3, 1, 4), (2, 1)) == (3, 2, 4)
    with pytest.raises(ValueError):
        broadcast_shapes((3,), (4,))


def test_arithmetic_broadcasts(spark, cube):
    x, a = cube
    y = np.array([[1.0], [-2.0], [0.5]])
    b = creation.array(spark, y)
    same((x + b).to_numpy(), a + y)
    same((x * x - 3).to_numpy(), a * a - 3)
    same((2 / (x + 10)).to_numpy(), 2 / (a + 10))
    n = creation.array(spark, np.array([7, -7, 3]))
    assert (n // 2).tolist() == [3, -4, 1] and (n % -3).tolist() == (np.array([7, -7, 3]) % -3).tolist() and (n**3).tolist() == [343, -343, 27]
    assert (n > 0).tolist() == [True, False, True]
    same(x.reduce(F.sum, axis=(0, 2)).to_numpy(), a.sum((0, 2)))
    same(x.reduce(F.max, axis=1, keepdims=True).to_numpy(), a.max(1, keepdims=True))
    same(x.scan(F.sum, lambda p, q: p + q, 2).to_numpy(), a.cumsum(2))


def test_joining(spark, cube):
    x, a = cube
    m, y = creation.array(spark, a[0]), a[0]
    same(joining.concatenate([m, m], 1).to_numpy(), np.concatenate([y, y], 1))
    same(joining.stack([m, m], 1).to_numpy(), np.stack([y, y], 1))
    same(joining.block([[m, m], [m, m]]).to_numpy(), np.block([[y, y], [y, y]]))
    for mode in ("edge", "reflect", "symmetric", "wrap", "constant", "linear_ramp", "maximum", "mean", "median"):
        same(joining.pad(m, [(1, 2), (2, 1)], mode).to_numpy(), np.pad(y, [(1, 2), (2, 1)], mode))
    same(joining.delete(m, [0, 2], 1).to_numpy(), np.delete(y, [0, 2], 1))
    same(joining.insert(m, [1, 1], [8.0, 9.0], 1).to_numpy(), np.insert(y, [1, 1], [8.0, 9.0], 1))
    same(joining.resize(m, (5, 4)).to_numpy(), np.resize(y, (5, 4)))
    assert [p.shape for p in joining.array_split(m, 3, 1)] == [p.shape for p in np.array_split(y, 3, 1)]
    bits = np.array([1, 0, 1, 1, 0, 0, 1, 0, 1, 1], bool)
    packed = joining.packbits(creation.array(spark, bits))
    assert packed.tolist() == np.packbits(bits).tolist()
    assert joining.unpackbits(packed).tolist() == np.unpackbits(np.packbits(bits)).tolist()


def test_contractions(spark, cube):
    x, a = cube
    b = a[0].T.copy()
    y = creation.array(spark, b)
    same(contractions.matmul(x, y).to_numpy(), a @ b)
    same(contractions.blocked_matmul(creation.array(spark, a[0]), y, 2).to_numpy(), a[0] @ b)
    same(contractions.tensordot(x, x, ((0, 1), (0, 1))).to_numpy(), np.tensordot(a, a, ((0, 1), (0, 1))))
    same(contractions.kron(y, creation.eye(spark, 2)).to_numpy(), np.kron(b, np.eye(2)))
    for s, args in (("ijk->k", (x,)), ("ijk,kl->ijl", (x, y)), ("ijk,ijk,kl->il", (x, x, y)), ("...k,kl", (x, y))):
        same(einsum(s, *args).to_numpy(), np.einsum(s, *[a if z is x else b for z in args]))
    square = creation.array(spark, np.arange(9.0).reshape(3, 3))
    same(einsum("ii->i", square).to_numpy(), [0, 4, 8])
    same(einsum("ii", square).to_numpy(), 12)
    assert einsum_path("ab,bc,cd->ad", (100, 2), (2, 100), (100, 3), how="optimal")[0] in ((1, 2), (0, 1))


def test_linear_algebra_and_fft(spark):
    r = np.random.default_rng(0)
    a = r.standard_normal((3, 4, 4)) + 4 * np.eye(4)
    x = creation.array(spark, a)
    close = lambda p, q: np.testing.assert_allclose(p, q, rtol=1e-8, atol=1e-10)
    close(stacks.inv(x).to_numpy(), np.linalg.inv(a))
    close(stacks.det(x).to_numpy(), np.linalg.det(a))
    q, t = stacks.qr(x)
    close(q.to_numpy() @ t.to_numpy(), a)
    u, s, v = stacks.svd(x)
    close(u.to_numpy() * s.to_numpy()[:, None, :] @ v.to_numpy(), a)
    close(stacks.solve(x, creation.array(spark, a[:, :, 1])).to_numpy(), np.tile([0, 1, 0, 0], (3, 1)))
    for f, g in ((stacks.fft, np.fft.fft), (stacks.rfft, np.fft.rfft), (stacks.fftn, np.fft.fftn), (stacks.ifft, np.fft.ifft)):
        close(f(x).to_numpy(), g(a))
    close(stacks.irfftn(stacks.rfftn(x)).to_numpy(), a)


def test_quantiles_follow_numpy(spark):
    values = np.array([1.0, 2.0, 2.0, 5.0, 9.0, 12.5, 13.0])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for method in quantiles.METHODS:
        got = {r["q"]: r["quantile"] for r in quantiles.quantiles(df, ["g"], "v", qs, method).collect()}
        for q in qs:
            assert got[q] == pytest.approx(np.quantile(values, q, method=method)), (method, q)
    holed = df.union(spark.createDataFrame([("g", math.nan)], "g string, v double"))
    assert math.isnan(quantiles.quantiles(holed, ["g"], "v", [0.5]).first()["quantile"])
    assert quantiles.quantiles(holed, ["g"], "v", [0.5], ignore_nan=True).first()["quantile"] == 5.0
    assert quantiles.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_histograms(spark):
    v = np.linspace(-10, 10, 50)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    edges = histograms.bin_edges(df, "v", 7)
    got = [r["count"] for r in histograms.histogram(df, "v", edges).orderBy("bin").collect()]
    assert got == np.histogram(v, edges)[0].tolist()
    for rule in ("sqrt", "sturges", "rice", "scott", "fd", "doane", "auto"):
        assert len(histograms.bin_edges(df, "v", rule)) == len(np.histogram_bin_edges(v, rule)), rule


def test_order_and_sets(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([3.0, math.nan, -1.0, 3.0, math.inf])], "k long, v double")
    assert [r["k"] for r in sets.argsort(df, "v", "k").orderBy("pos").collect()] == [2, 0, 3, 4, 1]
    assert [r["k"] for r in sets.sort(df, "v", True, [F.col("k")]).orderBy("pos").collect()] == [4, 0, 3, 2, 1]
    keys = spark.createDataFrame([(3.0,), (0.0,), (9.0,)], "x double")
    known = df.filter("k in (0, 2, 3)")
    assert {r["x"]: r["place"] for r in sets.searchsorted(known, "v", keys, "x").collect()} == {3.0: 1, 0.0: 1, 9.0: 3}
    assert {r["x"]: r["place"] for r in sets.searchsorted(known, "v", keys, "x", True).collect()} == {3.0: 3, 0.0: 1, 9.0: 3}
    assert [r["pos"] for r in numbered(df, ["k"]).orderBy("k").collect()] == [0, 1, 2, 3, 4]
    w = lanes.lane([], ["k"])
    assert [r[0] for r in df.filter("k != 1 and k != 4").select(lanes.diff(F.col("v"), w)).collect()] == [None, -4.0, 4.0]


def test_polynomials(spark):
    xs = [-1.5, 0.0, 0.3, 2.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    c = [1.0, -2.0, 0.5, 3.0]
    for kind, f in (("chebyshev", np.polynomial.chebyshev.chebval), ("hermite", np.polynomial.hermite.hermval), ("laguerre", np.polynomial.laguerre.lagval), ("legendre", np.polynomial.legendre.legval)):
        same([r[0] for r in df.select(polynomials.evaluate(F.col("x"), c, kind)).collect()], f(np.array(xs), c))


def test_random_is_seeded(spark):
    a, b = (default_rng(spark, 5).draw("gamma", 100, 2.0).to_numpy() for _ in range(2))
    assert (a == b).all()
    x = default_rng(spark, 5).normal(0.0, 1.0, 20000).df.agg(F.avg("v"), F.stddev("v")).first()
    assert abs(x[0]) < 0.05 and abs(x[1] - 1) < 0.05
    m = default_rng(spark, 6).permuted(creation.arange(spark, 12).reshape(3, 4), 1).to_numpy()
    assert np.sort(m, 1).tolist() == np.arange(12).reshape(3, 4).tolist()


def test_files(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    np.save(tmp_path / "f.npy", np.asfortranarray(a))
    np.savez_compressed(tmp_path / "z.npz", one=a, two=a.astype(">i4"))
    same(npy.load(spark, str(tmp_path / "f.npy")).to_numpy(), a)
    assert sorted(npy.members(spark, str(tmp_path / "z.npz"))) == ["one", "two"]
    assert npy.load(spark, str(tmp_path / "z.npz"), "two").to_numpy().tolist() == a.astype(int).tolist()
    npy.save(creation.array(spark, a), str(tmp_path / "out.npy"))
    same(np.load(tmp_path / "out.npy"), a)
    (tmp_path / "t.txt").write_text("# head\n1, 2,x\n\n3,,5 # tail\n")
    got = text.loadtxt(spark, str(tmp_path / "t.txt"), ",", missing=("x",)).to_numpy()
    np.testing.assert_array_equal(got, [[1, 2, np.nan], [3, np.nan, 5]])
    text.savetxt(creation.array(spark, a), str(tmp_path / "out"), "%.3f", header="h")
    same(text.loadtxt(spark, str(tmp_path / "out")).to_numpy(), a)


def test_streaming_window_matches_table(spark, tmp_path):
    from axisframe.streaming.rolling import tumbling

    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "v", ["g"], "30 minutes")
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("rolled").collect()))
    assert got == sorted(map(tuple, tumbling(rows, "ts", "v", ["g"], "30 minutes").collect())) and got


def test_empty_array(spark):
    x = creation.zeros(spark, [0, 3])
    assert x.to_numpy().shape == (0, 3) and (x + 1).df.count() == 0
    assert isinstance(x, NDFrame) and x.reduce(F.sum, axis=1).df.count() == 0
