"""Functions with signatures, large systems, tensors' equations, tall tables and complex products against numpy."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe import storage
from axisframe.operators import contractions, creation, generalized, systems
from axisframe.plans.einsum import einsum

R = np.random.default_rng(2)


def test_signatures():
    assert generalized.parse("(m,n),(n)->(m)") == ([("m", "n"), ("n",)], [("m",)])
    assert generalized.parse(" (), (3) -> (),(k , n) ") == ([(), ("3",)], [(), ("k", "n")])
    for wrong in ("(m,n)", "m->n", "(m,)->()", "(m)->", "(m)(n)->()"):
        with pytest.raises(ValueError):
            generalized.parse(wrong)
    with pytest.raises(ValueError):
        generalized.core_sizes([("n",), ("n",)], [(3,), (4,)])


def test_core_axes_are_taken_whole_and_others_broadcast(spark):
    a, b, c = R.normal(size=(4, 1, 2, 3)), R.normal(size=(5, 3)), R.normal(size=3)
    x, y, z = (creation.array(spark, v) for v in (a, b, c))
    times = generalized.gufunc(lambda m, v: np.einsum("bmn,bn->bm", m, v), "(m,n),(n)->(m)")
    np.testing.assert_allclose(times(x, y).to_numpy(), np.einsum("abmn,bn->abm", np.broadcast_to(a, (4, 5, 2, 3)), b), atol=1e-12)
    np.testing.assert_allclose(times(x, z).to_numpy(), a @ c, atol=1e-12)
    low, high = generalized.gufunc(lambda v: (v.min(1), v[:, :2]), "(n)->(),(2)", ["float64", "float32"])(y)
    np.testing.assert_allclose(low.to_numpy(), b.min(1))
    np.testing.assert_allclose(high.to_numpy(), b[:, :2].astype("f4"))
    w = b + 1j * b[::-1]
    got = generalized.gufunc(lambda v: v * 1j, "(n)->(n)", "complex128")(creation.array(spark, w))
    np.testing.assert_allclose(got.to_numpy(), w * 1j)
    with pytest.raises(ValueError):
        generalized.gufunc(lambda v: v, "(n)->(k)")(y)
    with pytest.raises(ValueError):
        times(x)


def test_functions_of_scalars(spark):
    a, b = R.integers(0, 9, (3, 4)), R.integers(1, 9, 4)
    x, y = creation.array(spark, a), creation.array(spark, b)
    np.testing.assert_array_equal(generalized.vectorize(lambda p, q: p % q if p > q else -q, "int64")(x, y).to_numpy(), np.vectorize(lambda p, q: p % q if p > q else -q)(a, b))
    np.testing.assert_allclose(generalized.vectorize(np.median, signature="(n)->()")(x).to_numpy(), np.median(a, axis=1))
    q, r = generalized.frompyfunc(divmod, 2, 2, "int64")(x, y)
    np.testing.assert_array_equal([q.to_numpy(), r.to_numpy()], np.divmod(a, b))
    for f in (np.sum, lambda v: v[:2], lambda v: np.outer(v, v)):
        for axis in (0, -1):
            np.testing.assert_allclose(generalized.apply_along_axis(f, axis, x).to_numpy(), np.apply_along_axis(f, axis, a))


def test_large_systems(spark):
    n = 23
    a = R.normal(size=(n, n))
    a[0, 0] = 0.0  # it takes a swap of rows
    b, many = R.normal(size=n), R.normal(size=(n, 6))
    x = creation.array(spark, a)
    for width in (4, 23, 40):
        np.testing.assert_allclose(systems.solve_panels(x, creation.array(spark, b), width).to_numpy(), np.linalg.solve(a, b), atol=1e-8)
    np.testing.assert_allclose(systems.solve_panels(x, creation.array(spark, many), 5).to_numpy(), np.linalg.solve(a, many), atol=1e-8)
    with pytest.raises(Exception, match="singular"):
        systems.solve_panels(creation.array(spark, np.ones((6, 6))), creation.array(spark, np.ones(6)), 2).to_numpy()


def test_panels_are_factored_in_groups_and_dropped(spark, monkeypatch):
    """At most two steps' tables are on disk at once; before, each step's stayed until the session ended."""
    n, width = 40, 4
    a, b = R.normal(size=(n, n)), R.normal(size=(n, 2))
    left = []
    dropped = systems.dropped

    def counted(spark, path):
        left.append(sum(p.name.startswith("panel") for p in Path(path.removeprefix("file:")).parent.iterdir()) - before)
        dropped(spark, path)

    x, y = creation.array(spark, a), creation.array(spark, b)
    here = Path(storage.new_path(spark, "panels").removeprefix("file:")).parent
    before = sum(p.name.startswith("panel") for p in here.iterdir()) if here.exists() else 0
    monkeypatch.setattr(systems, "dropped", counted)
    monkeypatch.setattr(systems, "PANEL_BYTES", 8 * n * width * 3)  # ten panels, three at once
    np.testing.assert_allclose(systems.solve_panels(x, y, width).to_numpy(), np.linalg.solve(a, b), atol=1e-8)
    assert left == [2] * 4
    assert sum(p.name.startswith("panel") for p in here.iterdir()) - before == 1


def test_products_by_blocks(spark, monkeypatch):
    a, b = R.normal(size=(7, 5)), R.normal(size=(5, 6))
    x, y = creation.array(spark, a), creation.array(spark, b)
    for most in (contractions.BROADCAST_BYTES, 0):  # the second matrix at once, or joined by a shuffle
        monkeypatch.setattr(contractions, "BROADCAST_BYTES", most)
        for block in (2, 4, 5, 8):
            out = contractions.blocked_matmul(x, y, block)
            np.testing.assert_allclose(out.to_numpy(), a @ b, atol=1e-12)
            assert out.df.count() == 42
    plan = contractions.blocked_matmul(x, y, 8).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2  # the blocks of both matrices; their products were grouped as well before


def test_tensor_equations(spark, monkeypatch):
    a, b = R.normal(size=(2, 3, 6)), R.normal(size=(2, 3))
    x, y = creation.array(spark, a), creation.array(spark, b)
    np.testing.assert_allclose(systems.tensorsolve(x, y).to_numpy(), np.linalg.tensorsolve(a, b), atol=1e-8)
    c, d = R.normal(size=(8, 4, 2)), R.normal(size=(4, 2))
    np.testing.assert_allclose(systems.tensorsolve(creation.array(spark, c), creation.array(spark, d), (0,)).to_numpy(), np.linalg.tensorsolve(c, d, (0,)), atol=1e-8)
    np.testing.assert_allclose(systems.tensorinv(x).to_numpy(), np.linalg.tensorinv(a), atol=1e-8)
    monkeypatch.setattr(systems, "FOLDED", 2)
    np.testing.assert_allclose(systems.tensorinv(x).to_numpy(), np.linalg.tensorinv(a), atol=1e-8)


def test_tall_tables(spark):
    m = R.normal(size=(90, 5)) @ R.normal(size=(5, 5))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(m)], "k long, e array<double>").repartition(4)
    u, s, vh = systems.svd_tall(df, "e", 5, "k")
    own = np.array([r["u"] for r in u.orderBy("k").collect()])
    np.testing.assert_allclose(s, np.linalg.svd(m, compute_uv=False), rtol=1e-10)
    np.testing.assert_allclose(own * s @ vh, m, atol=1e-9)
    np.testing.assert_allclose(own.T @ own, np.eye(5), atol=1e-9)
    assert systems.svd_tall(df.filter(F.lit(False)), "e", 5, "k")[0].count() == 0


def test_complex_products(spark):
    a, b = (R.normal(size=(3, 4)) + 1j * R.normal(size=(3, 4)) for _ in range(2))
    x, y = creation.array(spark, a), creation.array(spark, b)
    for got, want in (
        (contractions.matmul(x, y.T), a @ b.T),
        (contractions.dot(x, y.T), a.dot(b.T)),
        (contractions.vdot(x, y), np.vdot(a, b)),
        (contractions.vecdot(x, y), np.vecdot(a, b)),
        (contractions.kron(x, y), np.kron(a, b)),
        (einsum("ij,ij->", x, y), np.einsum("ij,ij->", a, b)),
        (einsum("ij->j", x), a.sum(0)),
        (einsum("ij,kj,k->i", x, y, creation.array(spark, np.arange(3.0))), np.einsum("ij,kj,k->i", a, b, np.arange(3.0))),
    ):
        np.testing.assert_allclose(got.to_numpy(), want, atol=1e-10)


def test_borders_of_several_constants(spark):
    from axisframe.operators import joining

    a = R.integers(1, 9, (2, 3)).astype(float)
    x = creation.array(spark, a)
    for widths, value in (([(1, 2), (0, 1)], (5, 7)), ([(1, 1), (2, 0)], ((1, 2), (3, 4))), ([(1, 0), (0, 1)], 6)):
        np.testing.assert_array_equal(joining.pad(x, widths, value=value).to_numpy(), np.pad(a, widths, constant_values=value))
    np.testing.assert_array_equal(joining.pad(x, [(0, 1), (1, 0)], "empty").to_numpy(), np.pad(a, [(0, 1), (1, 0)]))


def test_norms_and_polynomials(spark):
    from axisframe.functions.polynomials import Polynomial
    from axisframe.operators import stacks

    a = R.normal(size=(3, 4))
    x = creation.array(spark, a)
    for order in (None, "fro", "nuc", 1, -1, 2, -2, np.inf, -np.inf):
        np.testing.assert_allclose(stacks.norm(x, order).to_numpy(), np.linalg.norm(a, order), rtol=1e-9)
    for order in (None, 0, 1, 2, 3, 0.5, np.inf, -np.inf):
        np.testing.assert_allclose(stacks.norm(x, order, axis=1).to_numpy(), np.linalg.norm(a, order, axis=1), rtol=1e-9)
    assert stacks.norm(x, axis=0, keepdims=True).shape == (1, 4)
    p = Polynomial([1.0, -3.0, 2.0])
    np.testing.assert_allclose(p.evaluate_array(x).to_numpy(), np.polynomial.polynomial.polyval(a, [1, -3, 2]))
    np.testing.assert_allclose(Polynomial([1.0, -3.0, 2.0], "legendre").evaluate_array(x).to_numpy(), np.polynomial.legendre.legval(a, [1, -3, 2]))
    assert p.degree() == 2 and sorted(p.roots().real.round(9)) == [0.5, 1.0]
