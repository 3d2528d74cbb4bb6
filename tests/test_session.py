import numpy as np
import pytest

from tessera.functions import factors
from tessera.operators import eigen, krylov, precond
from tessera.operators.diff import forward
from tessera.plans import rules
from tessera.plans.algorithms import ALGORITHMS, CHOICES, algorithm, algorithm_names, check_algorithm, check_control, generic_factorization, solve_function
from tessera.plans.autotune import lu_flops
from tessera.plans.problem import Assumptions, Condition, EigenProblem, EigenTarget, LinearProblem, RetCode, WarmStart, Zeros
from tessera.plans.session import Session, solve
from tessera.sources.matrix import Coo, Operator, Shifted

RNG = np.random.default_rng(1)


def positive(n=30):
    a = RNG.standard_normal((n, n))
    return a @ a.T / n + 2 * np.eye(n)


def laplacian(n, d=2.0):
    return d * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)


@pytest.mark.parametrize("name", [n for n in algorithm_names() if n not in krylov.COUPLED])
def test_every_algorithm_solves_and_solves_again(name):
    alg = ALGORITHMS[name]
    make = (lambda: np.diag(RNG.random(30) + 1)) if alg.family == "diagonal" else (lambda: laplacian(30, 4 + RNG.random())) if alg.kernel == "ldlt" else positive
    a, b = make(), RNG.standard_normal(30)
    tol = 1e-4 if alg.kernel == "mixed_lu" else 1e-5
    s = Session(LinearProblem(a, b), name)
    for new_a, new_b in ((None, None), (None, RNG.standard_normal(30)), (make(), None), (make(), RNG.standard_normal(30))):
        if new_a is not None:
            a = new_a
            s.A = a
        if new_b is not None:
            b = new_b
            s.b = b
        got = s.solve()
        assert got.ok, (name, got.retcode)
        assert np.linalg.norm(a @ got.u - b) <= tol * np.linalg.norm(b)


def test_names_that_are_not_solved():
    with pytest.raises(ValueError, match="no algorithm"):
        algorithm("nothing")


@pytest.mark.parametrize("name", [*krylov.LEAST_SQUARES, "QRFactorization", "SVDFactorization", "NormalCholeskyFactorization"])
def test_least_squares(name):
    a, b = RNG.standard_normal((40, 12)), RNG.standard_normal(40)
    assert np.allclose(solve(LinearProblem(a, b), name, reltol=1e-10).u, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-7)


@pytest.mark.parametrize("name", [*krylov.LEAST_NORM, "QRFactorization", "SVDFactorization", "MinNormQR"])
def test_least_norm(name):
    a, b = RNG.standard_normal((12, 40)), RNG.standard_normal(12)
    assert np.allclose(solve(LinearProblem(a, b), name, reltol=1e-11, abstol=1e-11).u, np.linalg.pinv(a) @ b, atol=1e-7)


def test_square_only_names_are_refused_at_once():
    for shape in ((12, 4), (4, 12)):
        with pytest.raises(ValueError, match="square"):
            Session(LinearProblem(np.ones(shape), np.ones(shape[0])), "LUFactorization")


def test_return_codes_and_rescues():
    a, b = np.array([[1.0, 1], [1, 1]]), np.array([-1.0, 1])
    assert not solve(LinearProblem(a, b), "LUFactorization").ok
    assert not solve(LinearProblem(a, b), "QRFactorization").ok
    for name in ("QRFactorization(ColumnNorm())", "SVDFactorization", "KrylovJL_GMRES", None):
        assert solve(LinearProblem(a, b), name).ok
    assert solve(LinearProblem(a, b), "SimpleGMRES").retcode is RetCode.INFEASIBLE
    d = np.diag([1.0, 1, 1, 0])
    s = solve(LinearProblem(d, np.ones(4)), safety=False)
    assert s.retcode is RetCode.FAILURE
    assert (s.u == 0).all()
    r = solve(LinearProblem(laplacian(200), np.ones(200)), "cg", maxiters=1)
    assert r.retcode is RetCode.MAXITERS


def test_flags():
    a, b = positive(), RNG.standard_normal(30)
    s = Session(LinearProblem(a, b))
    assert s.fresh
    s.solve()
    assert not s.fresh
    s.b = b * 2
    s.solve()
    assert s.factored == 1
    s.A = a * 2
    assert s.fresh
    s.solve()
    assert s.factored == 2
    bad = Session(LinearProblem(np.ones((2, 2)), np.ones(2)), "LUFactorization")
    bad.solve()
    assert bad.fresh
    with pytest.raises(ValueError, match="tolerances"):
        s.update_tolerances(reltol=1e-3)
    with pytest.raises(TypeError, match="u0"):
        solve(LinearProblem(a, b), u0=b)


def test_preconditioners_are_built_when_stale():
    builds = []

    def precs(a, p):
        builds.append(p)
        return precond.jacobi(np.diag(a)), None

    a = laplacian(10, 10.0)
    s = Session(LinearProblem(a, np.ones(10)), "KrylovJL_GMRES", precs=precs)
    s.solve()
    s.reinit(A=a * 2, reuse_precs=True)
    s.solve()
    assert len(builds) == 1
    s.reinit(A=a * 3)
    s.solve()
    assert len(builds) == 2
    s.p = 7
    s.solve()
    assert builds[-1] == 7
    with pytest.raises(ValueError, match="preconditioner"):
        Session(LinearProblem(a, np.ones(10)), "KrylovJL_CRAIGMR", Pl=lambda x: x)


@pytest.mark.parametrize("sides", ["Pl", "Pr", "both"])
def test_gmres_with_either_side(sides):
    n = 6
    a = np.array([[10 + 5 * i if i == j else 0.3 * (i + j) for j in range(n)] for i in range(n)], float)
    p = precond.jacobi(np.diag(a))
    kw = {"both": {"Pl": p, "Pr": lambda x: x * 2}}.get(sides, {sides: p})
    b = RNG.standard_normal(n)
    u = solve(LinearProblem(a, b), "KrylovJL_GMRES", reltol=1e-12, **kw).u
    assert np.linalg.norm(a @ u - b) <= 1e-8 * np.linalg.norm(b)


@pytest.mark.parametrize("kind", [WarmStart.PREVIOUS, WarmStart.HEGEDUS])
def test_warm_start(kind):
    n = 100
    a = np.diag(4 + np.arange(1, n + 1) / n) - np.eye(n, k=1) - np.eye(n, k=-1) + 0.3 * np.eye(n, k=5)
    s = Session(LinearProblem(a, np.ones(n)), "KrylovJL_GMRES", reltol=1e-10, abstol=1e-10, warm_start=kind)
    assert s.solve().iters > 1
    assert s.solve().iters <= 1


def test_adjoint_shift_operator_function():
    a, b = positive(), RNG.standard_normal(30)
    a = a + np.triu(a) * 0.1
    assert np.allclose(a.T @ Session(LinearProblem(a, b)).solve(adjoint=True).u, b)
    op = Operator(a.shape, lambda x: a @ x, lambda y: a.T @ y)
    assert np.allclose(solve(LinearProblem(op, b), reltol=1e-12).u, np.linalg.solve(a, b), atol=1e-6)
    s = Session(LinearProblem(Shifted(a, 0.5), b))
    assert s.alg.name == "LUFactorization"
    s = Session(LinearProblem(Shifted(a, 0.5), b), "LHLFactorization")
    for g in (0.5, 0.1, -2.0):
        s.update_gamma(g)
        assert np.allclose((a - np.eye(30) / g) @ s.solve().u, b)
    assert s.factored == 1
    f = solve_function(lambda A, b, u, p, fresh, Pl, Pr, cache: np.linalg.solve(A, b))
    assert np.allclose(a @ solve(LinearProblem(a, b), f).u, b)
    g = generic_factorization(lambda m: lambda y: np.linalg.inv(m) @ y)
    assert np.allclose(a @ solve(LinearProblem(a, b), g).u, b)


def test_batched_right_hand_sides_and_tall_derivatives():
    a, b = positive(12), RNG.standard_normal((12, 4))
    assert np.allclose(a @ solve(LinearProblem(a, b)).u, b)
    assert np.allclose(a @ solve(LinearProblem(a, b), "KrylovJL_GMRES", reltol=1e-12).u, b, atol=1e-6)
    t, y = RNG.standard_normal((20, 4)), RNG.standard_normal(20)
    dt, dy = RNG.standard_normal((20, 4)), RNG.standard_normal(20)
    _, (du,), _ = forward(t, [dt], y, [dy])
    e = 1e-6
    num = (np.linalg.lstsq(t + e * dt, y + e * dy, rcond=None)[0] - np.linalg.lstsq(t - e * dt, y - e * dy, rcond=None)[0]) / (2 * e)
    assert np.allclose(du, num, atol=1e-5)


def test_eigenvalues():
    four = np.diag([1.0, 2, 3, 4])
    assert np.allclose(eigen.solve_eigen(EigenProblem(four)).u[0], [4, 3, 2, 1])
    assert np.allclose(eigen.solve_eigen(EigenProblem(four, count=2, target=EigenTarget.SMALLEST_MAGNITUDE)).u[0], [1, 2])
    assert np.allclose(eigen.solve_eigen(EigenProblem(four, count=2, shift=2.2)).u[0], [2, 3])
    assert np.allclose(eigen.solve_eigen(EigenProblem(four, B=2 * np.eye(4), count=2)).u[0], [2, 1.5])
    d = np.arange(1.0, 9)
    assert len(eigen.solve_eigen(EigenProblem(None), "ArpackJL", apply=lambda x: d * x, n=8).u[0]) == 6
    for args in (("JacobiDavidsonJL", EigenProblem(four)), ("ArnoldiMethodJL", EigenProblem(four, B=four)), ("ArnoldiMethodJL", EigenProblem(four, target=EigenTarget.SMALLEST_MAGNITUDE))):
        with pytest.raises(ValueError):
            eigen.solve_eigen(args[1], args[0])


def _laplacian(x):
    y = 2 * x
    y[1:] -= x[:-1]
    y[:-1] -= x[1:]
    return y


@pytest.mark.parametrize("n", [64, 400, 10_000])
def test_eigenvalues_are_right_or_not_called_so(n):
    s = eigen.solve_eigen(EigenProblem(None, count=3), "KrylovKitEigen", apply=_laplacian, n=n)
    want = 2 - 2 * np.cos(np.arange(n, n - 3, -1) * np.pi / (n + 1))
    assert s.ok == (n < 10_000)
    assert s.retcode in (RetCode.SUCCESS, RetCode.MAXITERS)
    assert not s.ok or np.allclose(s.u[0], want, atol=1e-9)


@pytest.mark.parametrize("target", ["LM", "LR", "SR", "LI"])
def test_eigenpairs_of_an_unsymmetric_matrix(target):
    a = np.random.default_rng(0).standard_normal((300, 300))
    s = eigen.solve_eigen(EigenProblem(None, count=4, target=EigenTarget(target)), "ArpackJL", apply=lambda x: a @ x, n=300)
    w = np.linalg.eigvals(a)
    want = w[eigen.selected(w, EigenTarget(target), 4)]
    assert s.ok
    assert np.allclose(np.sort_complex(s.u[0]), np.sort_complex(want), atol=1e-5)
    assert np.abs(a @ s.u[1] - s.u[1] * s.u[0]).max() < 1e-5


def test_rules():
    f = lambda **k: rules.default_choice(rules.Facts(**{"rows": 50, "cols": 50, **k}))
    assert f(kind="diagonal") == "DiagonalFactorization"
    assert f(kind="symtridiagonal") == "LDLtFactorization"
    assert f(kind="hermitian") == "CholeskyFactorization"
    assert f(kind="sparse", nnz=100) == "PureKLUFactorization"
    assert f(kind="sparse", rows=20_000, cols=20_000, nnz=100) == "SupernodalLUFactorization"
    assert f(kind="operator", rows=3) == "KrylovJL_CRAIGMR"
    assert f(kind="operator", cols=3) == "KrylovJL_LSMR"
    assert f(condition=Condition.SUPER_ILL) == "SVDFactorization"
    assert f(cols=3, condition=Condition.WELL) == "NormalCholeskyFactorization"
    assert f(rows=3) == "QRFactorization(ColumnNorm())"
    assert f(kind="static", cols=3) == "SVDFactorization"
    assert f(kind="shifted") == "LHLFactorization"
    assert f(gpu=True) == "QRFactorization"
    with pytest.raises(ValueError):
        f(kind="unknown", cols=3)
    assert Session(LinearProblem(np.eye(3), np.ones(3)), assumptions=Assumptions(condition=Condition.VERY_ILL)).alg.name == "QRFactorization"
    assert rules.placement(rules.Facts(10, 10, "tridiagonal")) == "native"
    assert rules.placement(rules.Facts(10**6, 3, "table")) == "reduced"
    assert rules.placement(rules.Facts(10**6, 10**6, "sparse")) == "packed"
    assert rules.placement(rules.Facts(10**9, 10**9, "sparse")) == "table"


def test_checks():
    with pytest.raises(ValueError, match="control"):
        check_control({"nonsense": 1})

    class Half:
        needs_square = 1

    assert len(check_algorithm(Half)) == 3
    assert lu_flops(1, 1) == 1
    assert lu_flops(2, 2) == 1 + 2 + 2 + 1


def test_two_grid_needs_few_steps():
    n = 300
    a, b = laplacian(n), np.ones(n)
    plain = solve(LinearProblem(a, b), "cg", reltol=1e-8)
    grids = solve(LinearProblem(a, b), "AlgebraicMultigridJL", reltol=1e-8)
    assert grids.ok
    assert grids.iters < plain.iters / 4


def test_nystrom():
    n = 200
    q = np.linalg.qr(RNG.standard_normal((n, n)))[0]
    a = q @ np.diag(np.geomspace(1e5, 1e-3, n)) @ q.T
    mu = 1e-2
    a = a + mu * np.eye(n)
    p = precond.nystrom(lambda x: a @ x - mu * x, n, 120, mu)
    b = RNG.standard_normal(n)
    assert solve(LinearProblem(a, b), "cg", Pl=p, reltol=1e-8, maxiters=5000).iters < solve(LinearProblem(a, b), "cg", reltol=1e-8, maxiters=5000).iters


def test_frozen_factor():
    a, b = positive(), RNG.standard_normal(30)
    s = Session(LinearProblem(a, b), "MKLPardisoIterate", reltol=1e-10)
    assert s.solve().iters <= 2
    s.A = a * 1.001
    assert np.allclose(s.A @ s.solve().u, b, atol=1e-6)
    assert s.prec_builds == 1


def test_messages(caplog):
    from tessera.plans.verbosity import NAMES, Verbosity

    a, b = np.ones((2, 2)), np.ones(2)
    with caplog.at_level("INFO", "tessera"):
        solve(LinearProblem(a, b))
        assert not caplog.records
        solve(LinearProblem(a, b), verbose="all")
        assert "pivoted QR" in caplog.text
        caplog.clear()
        solve(LinearProblem(a, b), verbose=Verbosity("all", {"error_control": 0}))
        assert "pivoted QR" not in caplog.text and "pivot 2 of 2 is zero" in caplog.text
        caplog.clear()
        solve(LinearProblem(a, b), verbose=Verbosity("all", {"error_control": 0, "numerical": 0}))
        assert not caplog.records
        solve(LinearProblem(np.array([[2.0, 1], [0, 3]]), b), "CholeskyFactorization")
        assert "not symmetric" in caplog.text
        caplog.clear()
        solve(LinearProblem(np.eye(2), b), "KrylovKitJL_CG")
        assert "KrylovKitJL_CG: 1 iterations" in caplog.text
    with pytest.raises(ValueError):
        Verbosity("loud")
    with pytest.raises(ValueError):
        Verbosity(changes={"nothing": 1})
    assert len(NAMES) == 17


def test_why_a_factor_fails():
    def trouble(a, kernel):
        return factors.factor(kernel, np.array(a, float)).trouble

    assert trouble([[1, 2], [2, 5]], "cholesky") is None
    assert trouble([[1, 2], [2, 1]], "cholesky") == ("blas_info", "Matrix is not positive definite")
    assert trouble([[1, 2], [0, 1]], "cholesky")[0] == "blas_invalid_args"
    assert trouble([[1, np.nan], [2, 1]], "lu") == ("blas_invalid_args", "entries that are not finite")
    assert trouble([[1, 1], [1, 1]], "lu") == ("blas_info", "pivot 2 of 2 is zero")
    assert trouble([[1, 0], [0, 0]], "bunch_kaufman") == ("blas_info", "column 2 of 2 is zero from its diagonal on")
    assert trouble([[1, 1], [1, 1]], "qr")[0] == trouble([[1, 0], [0, 0]], "ldlt")[0] == trouble([[1, 0], [0, 0]], "diagonal")[0] == "blas_info"
    assert trouble([[1, 1], [1, 1]], "svd") is None


def test_stored_zeros_in_a_session(spark):
    """Positions that are zero in all matrices so far leave the factor; answers stay those of the whole matrix."""
    n = 40

    def coo(k, wake=0):
        rows = [(i, j, 4.0 + k if i == j else 0.5 if wake and abs(i - j) == wake else 0.0) for i in range(n) for j in range(n) if abs(i - j) <= 3]
        return Coo(spark.createDataFrame(rows, "i long, j long, v double"), (n, n))

    b = np.arange(1.0, n + 1)
    s = Session(LinearProblem(coo(0), b), "KLUFactorization")
    for k, wake in enumerate((0, 1, 2, 0)):
        s.A = coo(k, wake)
        dense = np.zeros((n, n))
        for r in s.A.df.collect():
            dense[r["i"], r["j"]] = r["v"]
        assert np.allclose(dense @ s.solve().u, b)
    assert s._zeros.mode in ("union", "per_matrix")
    fixed = Session(LinearProblem(coo(0), b), "KLUFactorization", assumptions=Assumptions(zeros=Zeros.PERSISTENT))
    assert fixed.solve().retcode.ok
    fixed.A = Coo(spark.createDataFrame([(i, i, 1.0) for i in range(n)], "i long, j long, v double"), (n, n))
    with pytest.raises(ValueError, match="stored"):
        fixed.solve()


def test_adopted_choices(spark):
    from tessera.plans import autotune, rules

    rows = spark.createDataFrame([("Float64", "small", "QRFactorization"), ("ComplexF64", "small", "SVDFactorization"), ("Float16", "small", "LUFactorization")], "eltype string, size_class string, algorithm string")
    a, b = positive(), RNG.standard_normal(30)
    try:
        autotune.adopt(rows)
        assert Session(LinearProblem(a, b)).alg.name == "QRFactorization"
        assert Session(LinearProblem(a + 0j, b)).alg.name == "SVDFactorization"
        assert rules.default_choice(rules.Facts(500, 500)) == "LUFactorization"
        with pytest.raises(ValueError):
            autotune.adopt(rows.selectExpr("eltype", "size_class", "'Unheard' AS algorithm"))
    finally:
        autotune.forget()
    assert Session(LinearProblem(a, b)).alg.name == "LUFactorization"


@pytest.mark.parametrize("name, argument", [("HYPREAlgorithm", "solver"), ("PETScAlgorithm", "solver_type"), ("ElementalJL", "method")])
def test_every_choice_of_method(name, argument):
    a, b = positive(), RNG.standard_normal(30)
    for choice in CHOICES[name][1]:
        out = solve(LinearProblem(a, b), algorithm(name, **{argument: choice}))
        assert out.ok, choice
        assert np.allclose(a @ out.u, b, atol=1e-6), choice
    with pytest.raises(ValueError):
        algorithm(name, **{argument: "another"})


def test_choices_of_other_shapes():
    wide = RNG.standard_normal((5, 9))
    u = solve(LinearProblem(wide, np.ones(5)), algorithm("ElementalJL", method="LQ")).u
    assert np.allclose(u, np.linalg.pinv(wide) @ np.ones(5))
    tall = wide.T
    u = solve(LinearProblem(tall, np.arange(9.0)), algorithm("ElementalJL", method="QR")).u
    assert np.allclose(u, np.linalg.lstsq(tall, np.arange(9.0), rcond=None)[0])
    with pytest.raises(ValueError):
        solve(LinearProblem(wide, np.ones(5)), algorithm("ElementalJL", method="Cholesky"))


@pytest.mark.parametrize("name", [n for n in precond.NAMED if n not in ("none",)])
def test_named_preconditioners_save_iterations(name):
    n = 120
    scale = np.geomspace(1, 30, n)
    a, b = laplacian(n, 2.05) * np.sqrt(np.outer(scale, scale)), RNG.standard_normal(n)
    plain = solve(LinearProblem(a, b), algorithm("HYPREAlgorithm", solver="PCG"), reltol=1e-9, maxiters=2000)
    session = Session(LinearProblem(a, b), algorithm("HYPREAlgorithm", solver="PCG"), Pl=name, reltol=1e-9, maxiters=2000)
    out = session.solve()
    assert out.ok and np.allclose(a @ out.u, b, atol=1e-6)
    assert out.iters < plain.iters
    session.b = 2 * b
    assert np.allclose(session.solve().u, 2 * out.u, atol=1e-6) and session.prec_builds == 1
    session.A = a + np.eye(n)
    assert session.solve().ok and session.prec_builds == 2
    skew = a + 0.3 * (np.tril(a, -1) - np.triu(a, 1))  # flow in one direction; the diagonal still dominates
    if name == "icc":
        with pytest.raises(ValueError):
            solve(LinearProblem(skew, b), algorithm("PETScAlgorithm", pc_type=name))
        return
    out = solve(LinearProblem(skew, b), algorithm("PETScAlgorithm", solver_type="gmres", pc_type=name), reltol=1e-9, restart=n)
    assert out.ok and np.allclose(skew @ out.u, b, atol=1e-5)


def test_named_preconditioners_refuse_and_take_another_matrix():
    a, b = positive(), RNG.standard_normal(30)
    with pytest.raises(ValueError):
        solve(LinearProblem(a, b), "KrylovJL_CG", Pl="another")
    out = solve(LinearProblem(a, b), algorithm("PETScAlgorithm", solver_type="cg", pc_type="lu", prec_matrix=a))
    assert out.iters <= 2 and np.allclose(a @ out.u, b)


def test_transposed_null_space_and_guess():
    a, b = positive() + np.triu(RNG.standard_normal((30, 30)), 1) / 30, RNG.standard_normal(30)
    out = solve(LinearProblem(a, b), algorithm("PETScAlgorithm", transposed=True, pc_type="ilu"))
    assert np.allclose(a.T @ out.u, b, atol=1e-6)
    exact = np.linalg.solve(a, b)
    assert solve(LinearProblem(a, b, u0=exact), algorithm("PETScAlgorithm")).iters > 0
    assert solve(LinearProblem(a, b, u0=exact), algorithm("PETScAlgorithm", initial_guess_nonzero=True)).iters == 0
    ring = laplacian(20)
    ring[0, -1] = ring[-1, 0] = -1
    b = RNG.standard_normal(20)
    b -= b.mean()
    for own in ({"nullspace": "constant"}, {"nullspace": "custom", "nullspace_vecs": [np.ones(20)]}):
        u = solve(LinearProblem(ring, b), algorithm("PETScAlgorithm", solver_type="cg", **own)).u
        assert np.allclose(ring @ u, b, atol=1e-6) and abs(u.mean()) < 1e-9
    for wrong in ({"nullspace": "custom"}, {"nullspace": "other"}):
        with pytest.raises(ValueError):
            algorithm("PETScAlgorithm", **wrong)


def test_hybrid_turns_to_multigrid():
    n = 200
    a, b = laplacian(n), np.ones(n)
    assert not solve(LinearProblem(a, b), algorithm("HYPREAlgorithm", solver="PCG"), maxiters=30).ok
    session = Session(LinearProblem(a, b), algorithm("HYPREAlgorithm", solver="Hybrid"), maxiters=30)
    out = session.solve()
    assert out.ok and session.prec_builds == 2 and np.allclose(a @ out.u, b, atol=1e-4)


@pytest.mark.parametrize("name", ["KrylovJL_GMRES", "KrylovJL_FGMRES", "SimpleGMRES"])
def test_gmres_that_stalls_is_no_success(name):
    ring = np.roll(np.eye(50), 1, axis=0)  # no cycle of 20 steps lowers the residual, though the system has a solution
    b = np.eye(50)[0]
    assert solve(LinearProblem(ring, b), name, maxiters=500).retcode is RetCode.CONVERGENCE_FAILURE
    assert np.allclose(ring @ solve(LinearProblem(ring, b), name, maxiters=500, restart=50).u, b)
    a = np.array([[1.0, 1.0], [1.0, 1.0]])
    out = solve(LinearProblem(a, np.array([1.0, 3.0])), name, maxiters=50)  # least squares
    assert out.retcode is (RetCode.INFEASIBLE if name == "SimpleGMRES" else RetCode.SUCCESS) and np.allclose(a @ out.u, 2)
