import numpy as np
import pytest

from haruspex.functions.basis import Basis, multi_indices
from haruspex.operators import design, linalg


def _frozen():
    rng = np.random.default_rng(90210)
    xi = rng.normal(size=(2, 48))
    rng.normal(size=(2, 72))
    ids = rng.choice(48, size=18, replace=False)
    x = xi[:, ids]
    y = 1.5 + 0.7 * x[0] - 0.35 * (x[1] ** 2 - 1.0) + 0.15 * x[0] * x[1]
    X = Basis("hermite_e", 2, 3).vandermonde(x)
    return xi, X, y, 0.75 + (X**2).sum(1) / (2 * X.shape[1])


def test_indices_are_by_total_degree_and_product_order():
    assert multi_indices(2, 2) == [(0, 0), (0, 1), (1, 0), (0, 2), (1, 1), (2, 0)]


def test_hermite_matrix():
    V = Basis("hermite_e", 2, 2).vandermonde(np.array([[0.0, 1, -1], [0, 2, 1]]))
    s = np.sqrt(2)
    want = [[1, 0, 0, -1 / s, 0, -1 / s], [1, 2, 1, 3 / s, 2, 0], [1, 1, -1, 0, -1, 0]]
    assert np.allclose(V, want, atol=1e-14)


@pytest.mark.parametrize("family,params", [("hermite_e", (0, 0)), ("hermite", (0, 0)), ("legendre", (0, 0)), ("jacobi", (0.5, 1.5))])
def test_bases_are_orthonormal(family, params):
    b = Basis(family, 1, 5, params)
    x, w = b.gauss_nodes(8)
    V = b.vandermonde(x[None])
    assert np.allclose(V.T @ (V * w[:, None]), np.eye(6), atol=1e-10)


def test_frozen_path_and_designs():
    xi, X, y, w = _frozen()
    fit = linalg.fit_path(X, y, w, seed=73)
    assert fit.path == [0, 2, 3, 4] and fit.selected == [0, 2, 3, 4]
    P = Basis("hermite_e", 2, 2).vandermonde(xi)
    start = linalg.pivoted_rows(P, 6)
    assert start == [16, 9, 40, 34, 24, 3]
    assert design.greedy(P, 3, chosen=start, criterion="D") == [21, 29, 33]
    assert design.greedy(P, 3, chosen=start, criterion="S") == [6, 21, 35]


def test_pivoted_rows_agree_with_full_recomputation():
    X = np.random.default_rng(1).normal(size=(60, 8))
    A, want = X.copy(), []
    for _ in range(8):
        n = np.linalg.norm(A, axis=1)
        n[want] = -1
        k = int(np.argmax(n))
        want.append(k)
        q = A[k] / np.linalg.norm(A[k])
        A = A - np.outer(A @ q, q)
    assert linalg.pivoted_rows(X, 8) == want


def test_scores_are_log_determinants():
    rng = np.random.default_rng(2)
    A, B = rng.normal(size=(6, 4)), rng.normal(size=(5, 4))
    for k, row in enumerate(B):
        G = np.vstack([A, row])
        G = G.T @ G
        assert design.scores(A, B, "D")[k] == pytest.approx(np.linalg.slogdet(G)[1])
        assert design.scores(A, B, "S")[k] == pytest.approx(np.linalg.slogdet(G)[1] - np.log(np.diag(G)).sum())
    assert len(design.scores(A[:1], B, "D")) == 5  # fewer rows than columns: leading columns only
    with pytest.raises(ValueError):
        design.scores(A, B, "E")


def test_moments_fit_as_rows_do():
    rng = np.random.default_rng(8)
    X, w = rng.normal(size=(90, 7)) + 3, rng.uniform(0.5, 2, 90)
    y = 2 * X[:, 1] - X[:, 4] + 0.05 * rng.normal(size=90) + 5
    fit = linalg.fit_path(X, y, w, center=True, scale=True)
    Z = X[:, fit.selected]
    A = np.column_stack([np.ones(90), Z]) * np.sqrt(w)[:, None]
    want = np.linalg.lstsq(A, y * np.sqrt(w), rcond=None)[0]
    assert {1, 4} <= set(fit.selected) and np.allclose([fit.intercept, *fit.coefficients], want, atol=1e-8)
    errors = []
    for train, test in linalg.folds(90, 5, True, 0):
        m, ym = np.average(X, axis=0, weights=w), np.average(y, weights=w)
        P, t = (X - m)[:, fit.selected] * np.sqrt(w)[:, None], (y - ym) * np.sqrt(w)
        errors.append(np.mean((t[test] - P[test] @ np.linalg.lstsq(P[train], t[train], rcond=None)[0]) ** 2))
    assert fit.cv_error == pytest.approx(np.mean(errors), rel=1e-6)


@pytest.mark.parametrize("criterion", ["D", "S"])
def test_designs_of_large_pools_are_those_of_small_ones(spark, monkeypatch, criterion):
    X = np.random.default_rng(5).normal(size=(200, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "global_id long, a double, b double, c double")
    small = [design.select_design(df, ["a", "b", "c"], n, criterion=criterion, exclude=e) for n, e in ((6, []), (3, [7]), (2, [1, 2, 3, 4]))]
    monkeypatch.setattr(design, "SMALL_POOL", 0)
    assert [design.select_design(df, ["a", "b", "c"], n, criterion=criterion, exclude=e) for n, e in ((6, []), (3, [7]), (2, [1, 2, 3, 4]))] == small


def test_lars_of_a_table(spark):
    from haruspex.operators import surrogate

    rng = np.random.default_rng(6)
    xi = rng.normal(size=(300, 2))
    basis = Basis("hermite_e", 2, 3)
    V = basis.vandermonde(xi.T)
    y = V @ np.array([1.0, 0, 2, 0, 0, -1.5, 0, 0, 0, 0])
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(xi, y)], "x double, z double, y double")
    for s in (surrogate.fit_lars(df, basis, ["x", "z"], "y"), surrogate.fit_lasso(df, basis, ["x", "z"], "y")):
        coef = np.zeros(10)
        coef[list(s.active)] = s.coefficients
        assert np.allclose(V @ coef, y, atol=1e-6)
    assert surrogate.mallows_cp(df, basis, ["x", "z"], "y")[0] > 100


def test_folds_part_the_rows():
    parts = linalg.folds(11, 4, True, 3)
    assert sorted(np.concatenate([t for _, t in parts])) == list(range(11))
    assert [len(t) for _, t in parts] == [3, 3, 3, 2]
    with pytest.raises(ValueError):
        linalg.folds(1, 2)


def test_neighbourhood_fallbacks():
    xi = np.array([[0.0, 1, 2, 3, 10]])
    near = lambda **k: design.neighbourhood(xi, range(5), np.array([[0.0]]), 0.5, **k)
    assert near().ids == [0]
    grown = near(least=3, fallback="expand")
    assert grown.ids == [0, 1, 2] and grown.radius == 2.0
    assert near(least=2, fallback="global").ids == [0, 1]
    assert near(least=2, fallback="legacy_nearest").ids == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        near(least=2, fallback="unresolved")


def test_ellipsoid_holds_its_points():
    P = np.random.default_rng(0).normal(size=(50, 2)) * [3, 1]
    c, A = design.enclosing_ellipsoid(P, 1e-4)
    assert max((p - c) @ A @ (p - c) for p in P) <= 1.05


def test_lasso_finds_the_support():
    rng = np.random.default_rng(4)
    X = rng.normal(size=(80, 10))
    y = 3 * X[:, 2] - 2 * X[:, 7]
    fit = linalg.lasso_path_cv(X, y)
    assert {2, 7} <= set(fit.selected)
    assert np.allclose(fit.predict(X), y, atol=0.05)
