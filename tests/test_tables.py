"""Operators over tables that no query covers, and edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import algebra, batched, native, reduction, tall
from tessera.operators import packed as packed_module
from tessera.operators.packed import packed_operator, table_cg
from tessera.plans import autotune
from tessera.plans.problem import LinearProblem, Zeros
from tessera.plans.session import solve
from tessera.sources.matrix import Coo, DesignView, Diagonal, Tridiagonal, coo_rows, vector


def test_duplicates_add_up_and_missing_rows_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (2, 1, 4.0)], "i long, j long, v double")
    a = Coo.of(df)
    assert a.shape == (3, 2)
    got = algebra.filled(algebra.matvec(a.df, vector(spark, [1.0, 10.0])), spark.range(3).withColumnRenamed("id", "i"))
    assert {r["i"]: r["x"] for r in got.collect()} == {0: 3.0, 1: 0.0, 2: 40.0}


def test_one_triangle_is_mirrored(spark):
    a = Coo(coo_rows(spark, [[4.0, 9.0], [1.0, 3.0]]), (2, 2), symmetric="L")
    u = solve(LinearProblem(a, vector(spark, [1.0, 2.0]))).u
    assert np.allclose(np.array([[4.0, 1], [1, 3]]) @ u, [1, 2])


def test_packed_in_executors(spark, monkeypatch):
    monkeypatch.setattr(packed_module, "LOCAL_ENTRIES", 10)
    rng = np.random.default_rng(0)
    m = rng.standard_normal((20, 15))
    op = packed_operator(Coo(coo_rows(spark, m), m.shape))
    x, y = rng.standard_normal(15), rng.standard_normal(20)
    assert np.allclose(op.apply(x), m @ x)
    assert np.allclose(op.adjoint(y), m.T @ y)


def test_table_cg(spark):
    m = 4 * np.eye(8) - np.eye(8, k=1) - np.eye(8, k=-1)
    x, k, r = table_cg(coo_rows(spark, m), vector(spark, np.ones(8)), 20, 1e-10)
    u = np.array([r["x"] for r in x.orderBy("i").collect()])
    assert k <= 8
    assert np.allclose(m @ u, 1)


def test_structured_matrices(spark):
    d = Diagonal(spark.createDataFrame([(0, 2.0), (1, 4.0), (2, 5.0), (3, 8.0)], "i long, d double"))
    assert np.allclose(solve(LinearProblem(d, vector(spark, [0, 0, 1, 0]))).u, [0, 0, 0.2, 0])
    zero = Diagonal(spark.createDataFrame([(0, 0.0), (1, 4.0)], "i long, d double"))
    assert not solve(LinearProblem(zero, vector(spark, [1, 1]))).ok
    rows = [(i, 1.0, 4.0, 1.0) for i in range(4)]
    t = Tridiagonal(spark.createDataFrame(rows, "i long, dl double, d double, du double"))
    m = 4 * np.eye(4) + np.eye(4, k=1) + np.eye(4, k=-1)
    assert np.allclose(m @ solve(LinearProblem(t, vector(spark, [0, 0, 1, 0]))).u, [0, 0, 1, 0])


def test_native_zero_pivots_give_nulls(spark):
    d = spark.createDataFrame([(0, 0.0)], "i long, d double")
    assert native.diagonal_solve(d, vector(spark, [1.0])).first()["u"] is None
    t = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 2.0, 0.0, 1.0)], "i long, dl double, d double, du double, b double")
    assert all(r["u"] is None for r in native.tridiagonal_solve(t).collect())


@pytest.mark.parametrize("sizes", [(3, 3, 3, 3), (2, 3, 4)])
def test_blocks_equal_the_whole(spark, sizes):
    rng = np.random.default_rng(7)
    whole, b, entries, rhs, at = np.zeros((sum(sizes), sum(sizes))), rng.standard_normal(sum(sizes)), [], [], 0
    for k, n in enumerate(sizes):
        m = rng.random((n, n)) + n * np.eye(n)
        whole[at : at + n, at : at + n] = m
        entries += [(k, i, j, float(m[i, j])) for i in range(n) for j in range(n)]
        rhs += [(k, i, float(b[at + i])) for i in range(n)]
        at += n
    got = batched.block_diagonal(spark.createDataFrame(entries, "block_id long, i long, j long, v double"), spark.createDataFrame(rhs, "block_id long, i long, x double"))
    assert np.allclose([r["x"] for r in got.orderBy("block_id", "i").collect()], np.linalg.solve(whole, b))


def test_tall_tables(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 20))
    y = x @ np.arange(20) + 0.1 * rng.standard_normal(300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*[f"f{k}" for k in range(20)], "y"])
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    cols = [df[f"f{k}"] for k in range(20)]
    assert np.allclose(tall.tall_least_squares(df, cols, df["y"])[0], want)
    assert np.allclose(solve(LinearProblem(DesignView(df, [f"f{k}" for k in range(20)], "y"), None), "NormalCholeskyFactorization").u, want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    assert algebra.matvec(empty, vector(spark, [1.0])).count() == 0
    assert algebra.norm(spark.createDataFrame([], "i long, x double")).first()["norm"] == 0
    assert Coo.of(empty).shape == (0, 0)
    assert batched.small_batch(spark.createDataFrame([], "id long, a array<array<double>>, b array<double>")).count() == 0


def test_zero_reduction_modes(spark):
    def step(k, wake=()):
        return spark.createDataFrame([(i, j, 4.0 if i == j else float((i, j) in wake)) for i in range(4) for j in range(4)], "i long, j long, v double")

    r = reduction.ZeroReduction()
    assert r.reduced(step(0)).count() == 4
    assert r.mode == "union"
    assert r.reduced(step(1, {(0, 1)})).count() == 5
    assert r.reduced(step(2)).count() == 5
    r.reduced(step(3, {(i, j) for i in range(4) for j in range(4) if (i + j) % 4 != 3 and i != j}))
    assert r.mode == "per_matrix"
    p = reduction.ZeroReduction()
    zero = step(0).selectExpr("i", "j", "0D AS v")
    assert p.reduced(zero).count() == 16
    assert p.mode == "pending"
    p.reduced(step(1))
    assert p.mode == "union"
    fixed = reduction.ZeroReduction(Zeros.PERSISTENT)
    fixed.reduced(step(0))
    with pytest.raises(ValueError, match="stored"):
        fixed.reduced(step(0).limit(3))


def test_autotune_measures_and_keeps(spark, tmp_path):
    rows = autotune.measure(spark, sizes=(5, 25), algorithms=("LUFactorization", "QRFactorization"), seconds=0.01)
    assert autotune.usable(rows).count() == 4
    best = autotune.best(rows)
    autotune.keep(best, str(tmp_path / "choices"))
    assert autotune.kept(spark, str(tmp_path / "choices")).count() == best.count() == 2


def test_stream_of_right_hand_sides(spark, tmp_path):
    from tessera.streaming.resolve import resolve_stream

    spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id long, b array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, b array<double>").parquet(str(tmp_path / "in"))
    q = resolve_stream(stream, [[2.0, 1], [1, 3]], str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert np.allclose(np.array([[2.0, 1], [1, 3]]) @ r["u"], [r["id"], 1.0])


def chain(spark, n: int) -> tuple[Coo, np.ndarray, np.ndarray]:
    """4 and -1 on three diagonals, more rows than dense methods take, with a right-hand side and its solution."""
    k = np.arange(n)
    i, j = np.concatenate([k, k[1:], k[:-1]]), np.concatenate([k, k[:-1], k[1:]])
    v = np.where(i == j, 4.0, -1.0)
    u = np.sin(k) + 1
    b = 4 * u
    b[1:] -= u[:-1]
    b[:-1] -= u[1:]
    return Coo(spark.createDataFrame(pa.table({"i": i, "j": j, "v": v})), (n, n)), b, u


@pytest.mark.parametrize("name", ["AlgebraicMultigridJL", "PyAMG_RugeStuben"])
def test_multigrid_of_more_rows_than_dense_methods_take(spark, name):
    a, b, u = chain(spark, 6_000)
    s = solve(LinearProblem(a, b), name, abstol=1e-12, reltol=1e-12)
    assert s.ok and s.iters < 40
    assert np.allclose(s.u, u, atol=1e-9)


def test_multigrid_that_cannot_coarsen(spark):
    n = 6_000
    a = Coo(spark.range(n).selectExpr("id as i", "id as j", "double(1 + id % 5) as v"), (n, n))
    assert np.allclose(solve(LinearProblem(a, np.ones(n)), "AlgebraicMultigridJL").u, 1 / (1 + np.arange(n) % 5))


def test_ldlt_of_more_rows_than_dense_methods_take(spark):
    a, b, u = chain(spark, 6_000)
    both = Coo(a.df.selectExpr("i", "j", "v / 2 as v").union(a.df.selectExpr("i", "j", "v / 2 as v")).union(spark.createDataFrame([(0, 9, 1.0), (0, 9, -1.0)], "i long, j long, v double")), a.shape)  # repeated entries add up
    s = solve(LinearProblem(both, b), "LDLtFactorization", residual_safety=True, refine=1)
    assert s.ok
    assert np.allclose(s.u, u, atol=1e-12)
    for extra in ((0, 9), (1, 2)):
        off = Coo(a.df.union(spark.createDataFrame([(*extra, 1.0)], "i long, j long, v double")), a.shape)
        assert not solve(LinearProblem(off, b), "LDLtFactorization").ok


@pytest.mark.parametrize("blocks", [1, 2, 3, 777])
def test_a_column_twice_over_many_blocks(blocks):
    """The second pivot stays at rounding, however many blocks of rows there are."""
    rng = np.random.default_rng(5)
    x = (rng.integers(1, 51, (blocks, 5_000)) - 25.5) / 10
    made = tall.joined((np.column_stack([r, r]) for r in x), 2)
    assert abs(made[1, 1]) < tall.DEPENDENT / 5 * abs(made[0, 0])
    assert np.isclose(abs(made[0, 0]), np.linalg.norm(x))
    assert tall.joined(iter([]), 2).shape == (0, 2)
