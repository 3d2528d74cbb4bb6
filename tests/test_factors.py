"""Factors that are kept, the sparse factor, and Krylov methods with preconditioners or two blocks."""

import numpy as np
import pytest

from tessera.functions import factors, sparse
from tessera.operators import eigen, krylov, precond
from tessera.plans.algorithms import algorithm, generic_factorization
from tessera.plans.problem import Assumptions, EigenProblem, LinearProblem, RetCode
from tessera.plans.session import Session, solve
from tessera.sources.matrix import Coo, Structured

RNG = np.random.default_rng(11)


def positive(n=30):
    a = RNG.standard_normal((n, n))
    return a @ a.T / n + 2 * np.eye(n)


def laplacian(n):
    return 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)


@pytest.mark.parametrize("name", ["LUFactorization", "QRFactorization", "CholeskyFactorization", "BunchKaufmanFactorization", "SVDFactorization", "QRFactorization(ColumnNorm())", "NormalCholeskyFactorization", "MKL32MixedLUFactorization", None])
def test_one_factoring_for_many_right_hand_sides(name):
    a, b = positive(), RNG.standard_normal((4, 30))
    before = factors.MADE.total()
    s = Session(LinearProblem(a, b[0]), name)
    tol = 1e-4 if name and "32" in name else 1e-8
    for x in b:
        s.b = x
        assert np.linalg.norm(a @ s.solve().u - x) < tol * 30
        assert np.linalg.norm(a.T @ s.solve(adjoint=True).u - x) < tol * 30
    made = factors.MADE.total() - before
    assert made == (2 if name == "NormalCholeskyFactorization" else 1)  # the normal equations hold one inside
    assert s.factored == 1


def test_a_rescue_is_kept_and_a_users_factor_made_once():
    calls = []
    s = Session(LinearProblem(np.array([[1.0, 1], [1, 1]]), np.array([1.0, 1])))
    before = factors.MADE["PivotedQR"]
    for _ in range(3):
        assert np.allclose(s.solve().u, [0.5, 0.5])
    assert factors.MADE["PivotedQR"] == before + 1
    g = Session(LinearProblem(positive(), np.ones(30)), generic_factorization(lambda m: calls.append(1) or (lambda y: np.linalg.solve(m, y))))
    for _ in range(3):
        assert g.solve().ok
    assert len(calls) == 1


def test_wrong_structure_is_refused():
    assert not solve(LinearProblem(np.array([[2.0, 1], [0, 3]]), np.ones(2)), "CholeskyFactorization").ok
    assert not solve(LinearProblem(np.array([[2.0, 1, 1], [1, 3, 1], [1, 1, 4]]), np.ones(3)), "LDLtFactorization").ok
    a = np.array([[0.0, 1, 2], [1, 0, 3], [2, 3, 0]])
    assert np.allclose(a @ solve(LinearProblem(a, np.ones(3)), "BunchKaufmanFactorization").u, 1)
    with pytest.raises(ValueError, match="square"):
        Session(LinearProblem(np.ones((3, 2)), np.ones(3)), assumptions=Assumptions(square=True))


def test_structure_of_arrays_decides():
    a = positive(20)
    for kind, name in (("hermitian", "CholeskyFactorization"), ("symmetric", "BunchKaufmanFactorization"), ("banded", "LUFactorization"), ("almost_banded", "DirectLdiv"), ("block_diagonal", "LUFactorization"), ("unknown", "KrylovJL_GMRES")):
        s = Session(LinearProblem(Structured(a, kind), np.ones(20)))
        assert s.alg.name == name
        assert np.allclose(a @ s.solve().u, 1, atol=1e-5)
    f = factors.factor("lu", a)
    s = Session(LinearProblem(f, np.ones(20)))
    assert s.alg.name == "DirectLdiv"
    assert np.allclose(a @ s.solve().u, 1)


@pytest.mark.parametrize("name", ["minres", "symmlq", "cg_lanczos", "cr", "qmr", "bilq", "dqgmres", "diom", "lsqr", "lsmr", "lslq", "cgls", "crls", "cgne", "crmr", "lnlq", "craig"])
def test_preconditioners_are_called(name):
    calls = []

    def p(x):
        calls.append(1)
        return x / 2

    a = positive(20)
    s = solve(LinearProblem(a, np.ones(20)), name, Pl=p, reltol=1e-10)
    assert s.ok
    assert calls
    assert np.allclose(a @ s.u, 1, atol=1e-6)
    if name in ("lsqr", "lsmr", "lslq", "qmr"):
        calls.clear()
        assert np.allclose(a @ solve(LinearProblem(a, np.ones(20)), name, Pr=p, reltol=1e-10).u, 1, atol=1e-6)
        assert calls


def test_weights_of_rows_in_least_squares():
    a, b, w = RNG.standard_normal((30, 4)), RNG.standard_normal(30), RNG.random(30) + 0.5
    root = np.sqrt(w)
    want = np.linalg.lstsq(a * root[:, None], b * root, rcond=None)[0]
    for name in krylov.LEAST_SQUARES:
        assert np.allclose(solve(LinearProblem(a, b), name, Pl=lambda x: w * x, reltol=1e-12).u, want, atol=1e-7), name


def test_shortest_of_a_singular_system():
    q = np.linalg.qr(RNG.standard_normal((12, 12)))[0]
    a = q @ np.diag([1.0, 2, 3, -1, -2, 4, 5, 6, 0, 0, 0, 0]) @ q.T
    b = RNG.standard_normal(12)
    assert np.allclose(solve(LinearProblem(a, b), "minres_qlp").u, np.linalg.pinv(a) @ b, atol=1e-6)


def test_both_solutions_and_coupled_blocks():
    a, b, c = RNG.standard_normal((25, 25)) / 5 + 3 * np.eye(25), RNG.standard_normal(25), RNG.standard_normal(25)
    for name in ("bilqr", "trilqr"):
        s = solve(LinearProblem(a, b), name, c=c, reltol=1e-11)
        assert np.allclose(a @ s.u, b, atol=1e-6)
        assert np.allclose(a.T @ s.stats["t"], c, atol=1e-6)
    t, y = RNG.standard_normal((20, 7)), RNG.standard_normal(7)
    x = RNG.standard_normal(20)
    for name, sign in (("tricg", -1), ("trimr", -1), ("gpmr", 1)):
        s = solve(LinearProblem(t, x), name, c=y, reltol=1e-11)
        assert s.ok, name
        assert np.allclose(s.u + t @ s.stats["y"], x, atol=1e-7)
        assert np.allclose(t.T @ s.u + sign * s.stats["y"], y, atol=1e-7)


def test_user_algorithm_classes():
    class Mine:
        needs_square = True
        made = 0

        def init_cache(self, A, b):
            Mine.made += 1
            return np.linalg.inv(A)

        def solve(self, cache, A, b, u):
            return cache @ b

    a = positive(8)
    s = Session(LinearProblem(a, np.ones(8)), Mine())
    for _ in range(3):
        assert np.allclose(a @ s.solve().u, 1)
    assert Mine.made == 1

    class Half:
        def solve(self, cache, A, b, u):
            return b

    with pytest.raises(TypeError, match="init_cache"):
        Session(LinearProblem(a, np.ones(8)), Half())


def test_incomplete_factors_and_grids():
    n = 20
    a = np.kron(np.eye(n), laplacian(n)) + np.kron(laplacian(n), np.eye(n))
    b = RNG.standard_normal(n * n)
    plain = solve(LinearProblem(a, b), "cg", reltol=1e-9)
    for p in (precond.ic(a), precond.multigrid(a), precond.multigrid(a, "classical")):
        s = solve(LinearProblem(a, b), "cg", Pl=p, reltol=1e-9)
        assert s.ok
        assert s.iters < plain.iters / 2
    u = a + np.diag(np.full(n * n - 1, 0.7), 1)
    assert solve(LinearProblem(u, b), "KrylovJL_GMRES", Pr=precond.ilu(u), reltol=1e-9).iters < solve(LinearProblem(u, b), "KrylovJL_GMRES", reltol=1e-9).iters / 2


def test_sparse_factor_keeps_its_analysis():
    k = 30
    n = k * k
    a = np.kron(np.eye(k), laplacian(k)) + np.kron(laplacian(k), np.eye(k))
    a[0, 5] = 0.3
    i, j = np.nonzero(a)
    f = sparse.SparseFactor(i, j, a[i, j], n)
    b = RNG.standard_normal((n, 2))
    for m, x in ((a, f.solve(b)[0]), (a.T, f.solve(b, True)[0])):
        assert np.allclose(m @ x, b, atol=1e-9)
    before = factors.MADE["Analysis"]
    g = sparse.SparseFactor(i, j, a[i, j] * 2, n, analysis=f.analysis)
    assert factors.MADE["Analysis"] == before
    assert np.allclose(2 * a @ g.solve(b)[0], b, atol=1e-9)
    assert f.analysis.fill < n * n / 10
    assert sparse.SparseFactor([0, 1], [0, 0], [1.0, 1.0], 2).code is RetCode.INFEASIBLE
    assert sparse.SparseFactor([0, 1], [0, 1], [1.0, -1.0], 2, positive=True).code is RetCode.FAILURE
    p = sparse.SparseFactor([0, 1, 2, 3], [1, 0, 3, 2], [2.0, 3.0, 4.0, 5.0], 4)  # nothing on the diagonal
    assert np.allclose(p.solve(np.ones(4))[0], [1 / 3, 1 / 2, 1 / 5, 1 / 4])


@pytest.mark.parametrize("ordering", sparse.ORDERINGS)
@pytest.mark.parametrize("seed", range(40))
def test_sparse_factor_on_random_patterns(seed, ordering):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 150))
    a = (rng.random((m, m)) < rng.random() * 0.1) * rng.standard_normal((m, m)) + np.eye(m)[rng.permutation(m)] * 3
    i, j = np.nonzero(a)
    b = rng.standard_normal(m)
    f = sparse.SparseFactor(i, j, a[i, j], m, ordering=ordering)
    assert sorted(f.analysis.order) == list(range(m))
    u, code = f.solve(b)
    assert code.ok or np.linalg.cond(a) > 1e6
    if code.ok:
        assert np.linalg.norm(a @ u - b) <= 1e-6 * np.linalg.norm(b)


def test_least_degree_fills_less():
    """An arrow pointing the wrong way fills up in its own order, and not at all by least degree."""
    n = 300
    k = np.arange(1, n)
    i, j = np.concatenate([[0], k, k, 0 * k]), np.concatenate([[0], k, 0 * k, k])
    order, parent, touched = sparse.least_degree(*_graph(i, j, n), n)
    assert sum(touched) == n - 1
    assert 0 in order[-2:]
    f = sparse.SparseFactor(i, j, np.concatenate([[n], np.full(n - 1, 4.0), np.ones(2 * n - 2)]), n, ordering="amd")
    assert f.analysis.fill < 60 * n
    assert np.allclose(f.product(f.solve(np.ones(n))[0]), 1)
    with pytest.raises(ValueError, match="ordering"):
        sparse.SparseFactor(i, j, np.ones(len(i)), n, ordering="by name")


@pytest.mark.parametrize("seed", range(10))
def test_elimination_tree_and_counts(seed):
    """Parents, and how many later nodes each one touches, are those of elimination played out on the whole graph."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    a = rng.random((n, n)) < 0.06
    a |= a.T
    np.fill_diagonal(a, False)
    order, parent, touched = sparse.least_degree(*_graph(*np.nonzero(a), n), n)
    at = np.argsort(order)
    for v in order:
        later = [int(w) for w in np.flatnonzero(a[v]) if at[w] > at[v]]
        assert touched[v] == len(later)
        assert parent[v] == min(later, key=lambda w: at[w], default=-1)
        a[np.ix_(later, later)] = True
        a[later, later] = False


def _graph(i, j, n):
    off = i != j
    x, y = i[off], j[off]
    by = np.lexsort((y, x))
    return np.searchsorted(x[by], np.arange(n + 1)), y[by]


def test_ordering_by_name(spark):
    a, b = laplacian(60), RNG.standard_normal(60)
    i, j = np.nonzero(a)
    df = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), a[i, j].tolist())), "i long, j long, v double")
    s = Session(LinearProblem(Coo(df, (60, 60)), b), algorithm("SupernodalLUFactorization", ordering="amd"))
    assert np.allclose(a @ s.solve().u, b)
    assert s._factor.analysis.ordering == "amd"


def test_eigen_backend_of_a_user():
    class Own:
        def solve(self, problem, apply, n, inverse):
            return np.linalg.eigh(problem.A)

    found = eigen.solve_eigen(EigenProblem(np.diag([1.0, 5, 3]), count=2), Own())
    assert found.u[0].tolist() == [5, 3]
    assert np.abs(found.u[1][:, 0]).tolist() == [0, 1, 0]
    assert found.alg == "Own"
    with pytest.raises(TypeError, match="solve"):
        eigen.solve_eigen(EigenProblem(np.eye(2)), object())
