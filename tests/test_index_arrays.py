"""Index arrays, assignment, comparisons, lanes, element types and elimination against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe import dtypes
from axisframe.sources import npy, text
from axisframe.operators import comparison, creation, indexing, lanes, quantiles, stacks

A = np.arange(60.0).reshape(3, 4, 5) % 7 - 2


@pytest.fixture(scope="module")
def a(spark):
    x = creation.array(spark, A)
    x.df = x.df.repartition(3).persist()
    return x


KEYS = [
    ([0, 2], [1, -1]), (slice(None), [3, 0], [1, 1]), ([2, 0], slice(None), [4, 0]), (1, [0, 3]), ([1, 0, 1], slice(1, 4, 2)), (None, [0, 1], [2, 3]),
    (np.array([[0, 1], [2, 0]]),), (np.array([[0], [2]]), np.array([1, 3])), (..., [0, 2], [1, 1]), (slice(None), slice(None), [-1, 0]), ([0, 1], None, [2, 3]),
]


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_index_arrays(a, key):
    np.testing.assert_array_equal(a[key].to_numpy(), A[key])


@pytest.mark.parametrize("key, value", [((0,), 9), ((slice(None), [1, 3]), [[[1]], [[2]], [[3]]]), (([0, 2], [1, 1]), [[5.0] * 5, [6.0] * 5]), ((slice(0, 2), slice(None), 2), -1.5), ((slice(None), slice(None), [0, 0]), [1.0, 2.0])], ids=str)
def test_assignment(a, key, value):
    want = A.copy()
    want[key] = value
    np.testing.assert_array_equal(indexing.assign(a, key, value).to_numpy(), want)


def test_masks_and_places(a, spark):
    want = A.copy()
    want[A > 2] = 0
    np.testing.assert_array_equal(indexing.assign(a, a > 2, 0).to_numpy(), want)
    for f in ("putmask", "place"):
        want = A.copy()
        getattr(np, f)(want, A < 0, [10, 20, 30])
        np.testing.assert_array_equal(getattr(indexing, f)(a, a < 0, [10, 20, 30]).to_numpy(), want)
    np.testing.assert_array_equal(indexing.argwhere(a).to_numpy(), np.argwhere(A))
    np.testing.assert_array_equal(indexing.flatnonzero(a > 1).to_numpy(), np.flatnonzero(A > 1))
    order = np.argsort(A, axis=1, kind="stable")
    np.testing.assert_array_equal(indexing.take_along_axis(a, creation.array(spark, order), 1).to_numpy(), np.take_along_axis(A, order, 1))
    want, places = A.copy(), np.array([[[1, 0, 0, 2, 3]], [[0, 0, 0, 0, -1]], [[3, 2, 1, 0, 1]]])
    np.put_along_axis(want, places, 50.0, 1)
    np.testing.assert_array_equal(indexing.put_along_axis(a, creation.array(spark, places), 50.0, 1).to_numpy(), want)
    for got, expected in zip(indexing.unravel_index(creation.array(spark, [0, 59, -1, 17]), A.shape), np.unravel_index([0, 59, 59, 17], A.shape)):
        np.testing.assert_array_equal(got.to_numpy(), expected)
    parts = [[2, 5, -1], [3, 9, -4], [0, 1, 7]]
    for mode in ("wrap", "clip"):
        np.testing.assert_array_equal(indexing.ravel_multi_index([creation.array(spark, p) for p in parts], A.shape, mode).to_numpy(), np.ravel_multi_index(parts, A.shape, mode))
    for k, m in ((-1, None), (1, 6)):
        for f in ("tril_indices", "triu_indices"):
            for got, expected in zip(getattr(indexing, f)(spark, 4, k, m), getattr(np, f)(4, k, m)):
                np.testing.assert_array_equal(got.to_numpy(), expected)


def test_places_out_of_bounds_fail(a, spark):
    for f in (lambda: a[[0, 3], [0, 0]], lambda: indexing.unravel_index(creation.array(spark, [60]), A.shape)[0], lambda: indexing.ravel_multi_index([creation.array(spark, [3])], [3])):
        with pytest.raises(Exception, match="out of bounds"):
            f().to_numpy()


def test_comparisons(spark):
    nan = float("nan")
    x = creation.array(spark, [1.0, nan, float("inf")])
    assert not comparison.allclose(x, x) and comparison.allclose(x, x, equal_nan=True) and not comparison.array_equal(x, x) and comparison.array_equal(x, x, True)
    assert not comparison.allclose(creation.array(spark, [1.0]), creation.array(spark, [float("inf")])) and comparison.array_equiv(creation.ones(spark, [2, 3]), creation.ones(spark, [1, 3], "int64"))
    assert not comparison.array_equiv(creation.ones(spark, [2]), creation.ones(spark, [3])) and comparison.array_equal(creation.zeros(spark, [0]), creation.zeros(spark, [0]))
    z = creation.array(spark, np.array([1 + 1e-16j, 2 - 3e-16j]))
    assert comparison.isrealobj(comparison.real_if_close(z)) and comparison.iscomplexobj(comparison.real_if_close(z, 1e-20)) and comparison.iscomplex(z).tolist() == [True, True]


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolutions(spark, mode):
    x = np.array([1.0, -2.0, 3.0, 0.5, 4.0, 1.5])
    for kernel in ([1.0, 0.5], [0.25, 1.0, -1.0, 2.0], [2.0], list(range(1, 9))):
        np.testing.assert_allclose(lanes.convolve1d(creation.array(spark, x), kernel, mode).to_numpy(), np.convolve(x, kernel, mode))
        np.testing.assert_allclose(lanes.correlate(creation.array(spark, x), kernel, mode).to_numpy(), np.correlate(x, kernel, mode)) if mode != "valid" or len(kernel) <= len(x) else None


def test_lanes(a, spark):
    np.testing.assert_array_equal(lanes.partition(a, 2, 1).to_numpy(), np.sort(A, axis=1))
    np.testing.assert_array_equal(lanes.argpartition(a, 2, 1).to_numpy(), np.argsort(A, axis=1, kind="stable"))
    v = A.ravel()
    np.testing.assert_allclose(lanes.reduceat(a.ravel(), [0, 10, 5, 59], F.sum).to_numpy(), np.add.reduceat(v, [0, 10, 5, 59]))
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, x double").repartition(3)
    got = [r["v"] for r in lanes.ediff1d(df, ["k"], "x", [9.0, 8.0], [7.0]).orderBy("pos").collect()]
    np.testing.assert_array_equal(got, np.ediff1d(v, [7.0], [9.0, 8.0]))
    z = np.array([2 + 1j, 1 - 1j, 2 - 1j, 1 + 5j])
    np.testing.assert_array_equal(lanes.sort_complex(creation.array(spark, z)).to_numpy(), np.sort_complex(z))


def test_scans_over_blocks_of_blocks(spark, monkeypatch):
    from axisframe import frame

    monkeypatch.setattr(frame, "SCAN_BLOCK", 4)
    x = np.arange(150.0) % 11 - 5
    np.testing.assert_allclose(creation.array(spark, x).scan(F.sum, lambda p, q: p + q, 0).to_numpy(), np.cumsum(x))
    np.testing.assert_allclose(creation.array(spark, x.reshape(3, 50)).scan(F.max, F.greatest, 1).to_numpy(), np.maximum.accumulate(x.reshape(3, 50), 1))


def test_quantiles_of_one_group_and_of_null_groups(spark):
    r = np.random.default_rng(0)
    x = r.integers(0, 50, 400).astype(float)
    df = spark.createDataFrame([(None if k % 3 == 0 else "b", float(v)) for k, v in enumerate(x)], "g string, x double").repartition(4)
    whole = {q["q"]: q["quantile"] for q in quantiles.quantiles(df, [], "x", [0.0, 0.3, 0.77, 1.0]).collect()}
    np.testing.assert_allclose([whole[q] for q in (0.0, 0.3, 0.77, 1.0)], np.quantile(x, [0.0, 0.3, 0.77, 1.0]))
    for row in quantiles.quantiles(df, ["g"], "x", [0.4]).collect():
        own = [v for k, v in enumerate(x) if (k % 3 == 0) == (row["g"] is None)]
        assert row["quantile"] == pytest.approx(np.quantile(own, 0.4))


def test_elimination(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(4, 5, 5))
    m[0, 0, 0] = 0  # a pivot that has to be looked for
    x = creation.array(spark, m)
    np.testing.assert_allclose(stacks.inv(x).to_numpy(), np.linalg.inv(m), atol=1e-9)
    np.testing.assert_allclose(stacks.det(x).to_numpy(), np.linalg.det(m))
    for got, want in zip(stacks.slogdet(x), np.linalg.slogdet(m)):
        np.testing.assert_allclose(got.to_numpy(), want)
    b = r.normal(size=(4, 5))
    np.testing.assert_allclose(stacks.solve(x, creation.array(spark, b)).to_numpy(), np.linalg.solve(m, b[..., None])[..., 0], atol=1e-9)
    s = m @ m.swapaxes(1, 2) + np.eye(5)
    np.testing.assert_allclose(stacks.cholesky(creation.array(spark, s)).to_numpy(), np.linalg.cholesky(s), atol=1e-10)
    for power in (0, 1, 5, -2):
        np.testing.assert_allclose(stacks.matrix_power(x, power).to_numpy(), np.linalg.matrix_power(m, power), rtol=1e-6, atol=1e-8)
    for order in ("fro", "nuc", 1, -1, 2, -2, np.inf, -np.inf):
        np.testing.assert_allclose(stacks.matrix_norm(x, order).to_numpy(), np.linalg.norm(m, order, axis=(1, 2)))
    singular = creation.array(spark, [[[1.0, 2.0], [2.0, 4.0]]])
    assert stacks.det(singular).tolist() == [0.0] and stacks.slogdet(singular)[1].tolist() == [-np.inf]
    with pytest.raises(Exception, match="singular"):
        stacks.inv(singular).to_numpy()


def test_least_squares_of_nearly_collinear_columns(spark):
    x = np.linspace(0, 1, 200)
    rows = [(float(v), float(v + 1e-7 * (k % 5)), float(3 * v - 2 * (v + 1e-7 * (k % 5)) + 1)) for k, v in enumerate(x)]
    got = stacks.lstsq(spark.createDataFrame([*rows, (None, 1.0, 1.0)], "a double, b double, y double").repartition(5), ["a", "b"], "y")
    np.testing.assert_allclose([got["a"], got["b"], got["intercept"]], [3, -2, 1], rtol=1e-4)


def test_element_types():
    for name in ("float16", "float32", "float64"):
        got, want = dtypes.finfo(name), np.finfo(name)
        assert all(float(getattr(got, k)) == float(getattr(want, k)) for k in ("eps", "epsneg", "max", "min", "tiny", "smallest_subnormal")) and got.precision == want.precision
    for name in ("int8", "uint32", "int64"):
        assert (dtypes.iinfo(name).min, dtypes.iinfo(name).max) == (np.iinfo(name).min, np.iinfo(name).max)
    for x in (0, 255, 256, -1, -129, 2**40, 1.0, 1e5, 1e300, float("inf"), 2 + 0j, 1e300j, True):
        assert dtypes.min_scalar_type(x).name == np.min_scalar_type(x).name
    assert dtypes.issubdtype("float32", "floating") and not dtypes.issubdtype("int8", "inexact") and dtypes.issubdtype("signedinteger", "number") and dtypes.issubdtype("int", "int64")
    assert dtypes.isdtype("uint8", "integral") and dtypes.isdtype("complex64", ("bool", "numeric")) and not dtypes.isdtype("bool", "numeric")
    assert dtypes.common_type("int8", "float32").name == "float64" and dtypes.common_type("float32", "complex64").name == "complex64"
    assert [dtypes.mintypecode(x) for x in ("d", "fd", "fF", "dF", "i", "if")] == [np.mintypecode(x) for x in ("d", "fd", "fF", "dF", "i", "if")]


def test_files(spark, tmp_path):
    lines = "title\n# a comment\n1, 2, x\n\n3,,N/A # more\n4, 5\n7, 8, 9\nend"
    (tmp_path / "a.csv").write_text(lines)
    got = text.genfromtxt(spark, str(tmp_path / "a.csv"), ",", skip_header=1, skip_footer=1, missing_values=("N/A",), filling_values={1: -1.0, 2: -2.0}, invalid_raise=False)
    np.testing.assert_array_equal(got.to_numpy(), [[1, 2, -2], [3, -1, -2], [7, 8, 9]])
    with pytest.raises(Exception, match="different numbers"):
        text.genfromtxt(spark, str(tmp_path / "a.csv"), ",", skip_header=1, skip_footer=1).to_numpy()
    (tmp_path / "b.txt").write_text(" 12 345\n 67 890\n")
    np.testing.assert_array_equal(text.genfromtxt(spark, str(tmp_path / "b.txt"), [3, 2, 2], usecols=[0, -1]).to_numpy(), [[12, 45], [67, 90]])
    x = np.arange(-5, 1000, dtype="int16")
    x.tofile(tmp_path / "c.bin")
    np.testing.assert_array_equal(npy.fromfile(spark, str(tmp_path / "c.bin"), "int16", 7, offset=4).to_numpy(), x[2:9])
    np.testing.assert_array_equal(npy.fromfile(spark, str(tmp_path / "c.bin"), "int16").to_numpy(), x)
    (tmp_path / "d.txt").write_text("1,2,3\n4,5\n")
    np.testing.assert_array_equal(npy.fromfile(spark, str(tmp_path / "d.txt"), "int64", 4, ",").to_numpy(), [1, 2, 3, 4])
    np.savez(tmp_path / "e.npz", first=x, second=A)
    with_names = npy.NpzFile(spark, str(tmp_path / "e.npz"))
    assert list(with_names) == ["first", "second"] and "third" not in with_names
    np.testing.assert_array_equal(with_names["second"].to_numpy(), A)


def test_made_from_nothing(spark):
    np.testing.assert_allclose([g.to_numpy() for g in creation.mgrid(spark)[0:3, 0:1:5j]], np.mgrid[0:3, 0:1:5j])
    for got, want in zip(creation.ogrid(spark)[2:5, 0:8:3], np.ogrid[2:5, 0:8:3]):
        np.testing.assert_array_equal(got.to_numpy(), want)
    np.testing.assert_array_equal(creation.diagflat(creation.array(spark, [[1, 2], [3, 4]]), -1).to_numpy(), np.diagflat([[1, 2], [3, 4]], -1))
    with pytest.raises(Exception, match="infs or NaNs"):
        creation.asarray_chkfinite(spark, [1.0, float("nan")]).to_numpy()


def test_orthogonal_factors_are_worked_out_in_the_jvm(spark):
    r = np.random.default_rng(4)
    for shape in ((3, 4, 4), (2, 6, 3), (2, 3, 5), (4, 2, 2), (2, 1, 1)):
        a = r.normal(size=shape) * 10.0 ** r.integers(-3, 4)
        x = creation.array(spark, a)
        u, s, v = (y.to_numpy() for y in stacks.svd(x))
        np.testing.assert_allclose(s, np.linalg.svd(a, compute_uv=False), rtol=1e-10)
        np.testing.assert_allclose(u * s[:, None, :] @ v, a, atol=1e-10 * abs(a).max())
        np.testing.assert_allclose(np.swapaxes(u, 1, 2) @ u, np.broadcast_to(np.eye(min(shape[1:])), (shape[0],) + (min(shape[1:]),) * 2), atol=1e-10)
        np.testing.assert_allclose(stacks.pinv(x).to_numpy() * abs(a).max(), np.linalg.pinv(a) * abs(a).max(), atol=1e-7)
        np.testing.assert_allclose(stacks.cond(x).to_numpy(), np.linalg.cond(a), rtol=1e-7)
        q, t = (y.to_numpy() for y in stacks.qr(x))
        wq, wt = np.linalg.qr(a)
        np.testing.assert_allclose(q, wq, atol=1e-10)
        np.testing.assert_allclose(t, wt, atol=1e-10 * abs(a).max())
        if shape[1] == shape[2]:
            h = a + np.swapaxes(a, 1, 2)
            w, e = (y.to_numpy() for y in stacks.eigh(creation.array(spark, h)))
            np.testing.assert_allclose(w, np.linalg.eigvalsh(h), atol=1e-10 * abs(h).max())
            np.testing.assert_allclose(h @ e, e * w[:, None, :], atol=1e-9 * abs(h).max())


def test_lacking_ranks_and_tiny_scales(spark):
    a = np.array([[[1.0, 2, 3], [2, 4, 6], [1, 0, 1]], [[0.0] * 3] * 3, [[1e-200, 0, 0], [0, 2e-200, 0], [0, 0, 3e-200]]])
    x = creation.array(spark, a)
    assert stacks.matrix_rank(x).to_numpy().tolist() == [2, 0, 3]
    u, s, v = (y.to_numpy() for y in stacks.svd(x))
    np.testing.assert_allclose(np.swapaxes(u, 1, 2) @ u, np.broadcast_to(np.eye(3), (3, 3, 3)), atol=1e-10)
    np.testing.assert_allclose(u * s[:, None, :] @ v, a, atol=1e-10)
    tiny = creation.array(spark, np.diag([1e-200, 2e-200])[None])
    np.testing.assert_allclose(stacks.inv(tiny).to_numpy()[0], np.diag([1e200, 5e199]), rtol=1e-12)
    big = creation.array(spark, np.diag([1e200, 2e200, 4e200])[None])
    np.testing.assert_allclose(stacks.solve(big, creation.array(spark, np.array([[1e200, 2e200, 8e200]]))).to_numpy()[0], [1, 1, 2])


def test_long_lanes_are_divided_without_a_sort(spark, monkeypatch):
    from axisframe.operators import selection

    monkeypatch.setattr(selection, "WHOLE", 8)
    monkeypatch.setattr(selection, "BLOCK", 16)
    monkeypatch.setattr(selection, "PIVOTS", 3)
    r = np.random.default_rng(8)
    a = np.stack([r.permutation(150).astype(float), r.integers(0, 4, 150).astype(float), np.where(np.arange(150) % 3, np.nan, np.arange(150))])
    x = creation.array(spark, a)
    for kth in (0, 70, 149):
        got, places = lanes.partition(x, kth, 1).to_numpy(), lanes.argpartition(x, kth, 1).to_numpy()
        np.testing.assert_array_equal(np.take_along_axis(a, places, 1), got)
        want = np.sort(a, axis=1)
        np.testing.assert_array_equal(got[:, kth], want[:, kth])
        np.testing.assert_array_equal(np.sort(got[:, :kth], axis=1), want[:, :kth])
        np.testing.assert_array_equal(np.sort(got[:, kth:], axis=1), want[:, kth:])
    lone = lanes.partition(creation.array(spark, a[0]), 30).to_numpy()
    assert lone[30] == 30 and lone[:30].max() < 30
