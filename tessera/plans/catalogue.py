"""The engine's queries over the driver's tables, each with equivalent SQL where there is one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dense
from ..operators import algebra, batched, diff, eigen, krylov, native, precond, reduction, tall
from ..operators.packed import packed_operator, table_cg
from ..sources.matrix import Coo, DesignView, Operator
from . import autotune, rules
from .algorithms import algorithm
from .problem import Condition, EigenProblem, EigenTarget, LinearProblem, WarmStart
from .session import Session, solve

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ least squares over lineitem

# Features are centred: the plain Gram matrix has a condition number of about 1.6e6.
FEATURES = ("1D", "(l_quantity - 25.5D) / 10D", "(l_discount - 0.05D) * 10D")
_X = "SELECT CAST(1 AS DOUBLE) AS x0, (l_quantity - 25.5) / 10 AS x1, (l_discount - 0.05) * 10 AS x2, l_extendedprice AS y, l_tax * 100 AS z FROM lineitem"


def _sums(ridge: float = 0.0) -> str:
    cells = [f"sum(x{i} * x{j}){f' + {ridge}' if i == j and ridge else ''} AS a{i}{j}" for i in range(3) for j in range(3)]
    return ", ".join(cells + [f"sum(x{i} * {t}) AS {t}{i}" for t in "yz" for i in range(3)])


def _det(m: list[list[str]]) -> str:
    a = m
    return (
        f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]})"
        f" + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"
    )


def _cramer(t: str, k: int, a=lambda r, c: f"a{r}{c}") -> str:
    m = [[a(r, c) for c in range(3)] for r in range(3)]
    return f"{_det([[f'{t}{r}' if c == k else m[r][c] for c in range(3)] for r in range(3)])} / {_det(m)}"


def _fit_sql(ridge: float = 0.0, digits: int = 3) -> str:
    parts = [f"SELECT CAST({k} AS BIGINT) AS i, round({_cramer('y', k)}, {digits}) AS coef, 'Success' AS retcode FROM s" for k in range(3)]
    return f"WITH t AS ({_X}), s AS (SELECT {_sums(ridge)} FROM t) " + " UNION ALL ".join(parts)


def _coefficients(spark: SparkSession, u, retcode: str, digits: int = 3) -> DataFrame:
    rows = spark.createDataFrame([(k, float(x), retcode) for k, x in enumerate(u)], "i long, coef double, retcode string")
    return rows.withColumn("coef", F.round("coef", digits))


@query(_fit_sql())
def normal_cholesky(spark, sf_dir):
    view = DesignView(table(spark, sf_dir, "lineitem"), FEATURES, "l_extendedprice")
    s = solve(LinearProblem(view, None), "NormalCholeskyFactorization")
    return _coefficients(spark, s.u, s.retcode.value)


@query(_fit_sql())
def qr_least_squares(spark, sf_dir):
    u, code = tall.tall_least_squares(table(spark, sf_dir, "lineitem"), [F.expr(e) for e in FEATURES], F.col("l_extendedprice"))
    return _coefficients(spark, u, code.value)


@query(_fit_sql())
def default_least_squares(spark, sf_dir):
    """A tall table without a named method, said to be well conditioned."""
    view = DesignView(table(spark, sf_dir, "lineitem"), FEATURES, "l_extendedprice")
    name = rules.default_choice(rules.Facts(10**6, 3, condition=Condition.WELL))
    s = solve(LinearProblem(view, None), name)
    return _coefficients(spark, s.u, s.retcode.value)


@query(_fit_sql(1000.0))
def ridge(spark, sf_dir):
    g = batched.to_dense(algebra.gram(table(spark, sf_dir, "lineitem"), [F.expr(e) for e in FEATURES], F.col("l_extendedprice")), (3, 4))
    s = solve(LinearProblem(g[:, :3] + 1000.0 * np.eye(3), g[:, 3]), "CholeskyFactorization")
    return _coefficients(spark, s.u, s.retcode.value)


@query(
    f"WITH t AS ({_X}), s AS (SELECT {_sums()} FROM t) "
    + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS i, CAST({c} AS INTEGER) AS k, round({_cramer(t, k)}, 3) AS coef FROM s" for c, t in enumerate("yz") for k in range(3))
)
def batched_rhs(spark, sf_dir):
    """Two targets with one Gram matrix and one factor."""
    li, xs = table(spark, sf_dir, "lineitem"), [F.expr(e) for e in FEATURES]
    both = algebra.gram(li, [*xs, F.col("l_extendedprice"), F.col("l_tax") * 100])
    g = batched.to_dense(both, (5, 5))
    s = solve(LinearProblem(g[:3, :3], g[:3, 3:]), "CholeskyFactorization")
    return spark.createDataFrame([(i, k, float(s.u[i, k])) for i in range(3) for k in range(2)], "i long, k int, coef double").withColumn("coef", F.round("coef", 3))


@query(
    f"WITH t AS ({_X}) "
    + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round(sum({'y' if j == 3 else f'x{j}'} * x{i}) / 1000, 4) AS v FROM t" for i in range(3) for j in range(4))
)
def gram_matrix(spark, sf_dir):
    g = algebra.gram(table(spark, sf_dir, "lineitem"), [F.expr(e) for e in FEATURES], F.col("l_extendedprice"))
    return g.select("i", "j", F.round(F.col("v") / 1000, 4).alias("v"))


@query(
    f"WITH t AS ({_X}), s AS (SELECT {_sums()} FROM t), c AS (SELECT {', '.join(f'{_cramer("y", k)} AS c{k}' for k in range(3))} FROM s) "
    "SELECT round(sqrt(sum((y - c0 * x0 - c1 * x1 - c2 * x2) * (y - c0 * x0 - c1 * x1 - c2 * x2))) / 1000, 3) AS norm, 'APosterioriSafetyFailure' AS retcode FROM t, c"
)
def residual_norm(spark, sf_dir):
    """The fit's residual in one pass, and the code that a square system with such a residual would get."""
    li = table(spark, sf_dir, "lineitem")
    s = solve(LinearProblem(DesignView(li, FEATURES, "l_extendedprice"), None), "NormalCholeskyFactorization")
    r = F.col("l_extendedprice") - sum(F.lit(float(c)) * F.expr(e) for c, e in zip(s.u, FEATURES))
    return li.agg(F.sqrt(F.sum(r * r)).alias("n"), F.sqrt(F.sum(F.col("l_extendedprice") ** 2)).alias("b")).select(
        F.round(F.col("n") / 1000, 3).alias("norm"), F.when(F.col("n") > 1.5e-8 * (1 + F.col("b")), "APosterioriSafetyFailure").otherwise("Success").alias("retcode")
    )


# ------------------------------------------------------------------ matrix products

_A = "WITH a AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) "


def _part_supplier(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(_A + "SELECT i, round(sum(v * s_acctbal), 2) AS x FROM a JOIN supplier ON s_suppkey = j GROUP BY i")
def matvec_coo(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    return algebra.matvec(_part_supplier(spark, sf_dir), x).select("i", F.round("x", 2).alias("x"))


@query(_A + "SELECT j AS i, round(sum(v * p_retailprice), 2) AS x FROM a JOIN part ON p_partkey = i GROUP BY j")
def matvec_transpose(spark, sf_dir):
    y = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    return algebra.matvec_transpose(_part_supplier(spark, sf_dir), y).select("i", F.round("x", 2).alias("x"))


@query(
    "WITH a AS (SELECT l_returnflag || l_linestatus AS r, l_suppkey % 10 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) "
    "SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 1) AS v FROM a JOIN a AS b USING (r) GROUP BY a.j, b.j"
)
def sparse_gram(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("i"), (F.col("l_suppkey") % 10).alias("j")).agg(F.sum("l_quantity").alias("v"))
    return algebra.sparse_gram(a).select("i", "j", F.round("v", 1).alias("v"))


# ------------------------------------------------------------------ native solvers


@query("SELECT s_suppkey AS i, round(s_acctbal / (1 + s_suppkey % 7), 5) AS u FROM supplier")
def diagonal_solve(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    d = s.select(F.col("s_suppkey").alias("i"), (1 + F.col("s_suppkey") % 7).cast("double").alias("d"))
    return native.diagonal_solve(d, s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))).select("i", F.round("u", 5).alias("u"))


def _thomas(rows: str, key: str = "k") -> str:
    """Elimination and back substitution as recursions over rows (k, r, n, dl, d, du, b)."""
    return f"""WITH RECURSIVE t AS ({rows}),
f(k, r, c, y) AS (SELECT k, r, du / d, b / d FROM t WHERE r = 1
  UNION ALL SELECT t.k, t.r, t.du / (t.d - t.dl * f.c), (t.b - t.dl * f.y) / (t.d - t.dl * f.c) FROM f JOIN t ON t.k = f.k AND t.r = f.r + 1),
m AS (SELECT k, max(r) AS n FROM t GROUP BY k),
g(k, r, u) AS (SELECT f.k, f.r, f.y FROM f JOIN m ON m.k = f.k AND m.n = f.r
  UNION ALL SELECT f.k, f.r, f.y - f.c * g.u FROM g JOIN f ON f.k = g.k AND f.r = g.r - 1)
"""


_BY_NATION = "SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, CAST(-1 AS DOUBLE) AS dl, CAST(4 AS DOUBLE) AS d, CAST({du} AS DOUBLE) AS du, s_acctbal AS b FROM supplier"


def _nation_rows(spark, sf_dir, du: float) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_nationkey", r.cast("long").alias("i"), F.lit(-1.0).alias("dl"), F.lit(4.0).alias("d"), F.lit(du).alias("du"), F.col("s_acctbal").alias("b"))


@query(_thomas(_BY_NATION.format(du=-1)) + "SELECT k AS s_nationkey, r AS i, round(u, 4) AS u FROM g")
def tridiagonal_solve(spark, sf_dir):
    """A system for each nation's suppliers in order, all side by side."""
    return native.tridiagonal_solve(_nation_rows(spark, sf_dir, -1.0), "s_nationkey").select("s_nationkey", "i", F.round("u", 4).alias("u"))


@query(_thomas(_BY_NATION.format(du=0)) + "SELECT k AS s_nationkey, r AS i, round(u, 4) AS u FROM g")
def bidiagonal_solve(spark, sf_dir):
    return native.tridiagonal_solve(_nation_rows(spark, sf_dir, 0.0), "s_nationkey").select("s_nationkey", "i", F.round("u", 4).alias("u"))


@query("SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY l_suppkey")
def block_diagonal_ols(spark, sf_dir):
    fit = native.grouped_line(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_quantity"), F.col("l_extendedprice"))
    return fit.select("l_suppkey", F.round("intercept", 2).alias("intercept"), F.round("slope", 3).alias("slope"))


@query(
    f"WITH t AS ({_X.replace(' FROM', ', l_suppkey FROM')}), s AS (SELECT l_suppkey, {_sums()} FROM t GROUP BY l_suppkey) "
    f"SELECT l_suppkey, {', '.join(f'round({_cramer("y", k)}, 2) AS c{k}' for k in range(3))}, 'Success' AS retcode FROM s"
)
def grouped_least_squares(spark, sf_dir):
    fit = batched.grouped_least_squares(table(spark, sf_dir, "lineitem"), "l_suppkey", list(FEATURES), "l_extendedprice")
    return fit.select("l_suppkey", *[F.round(F.col("coef")[k], 2).alias(f"c{k}") for k in range(3)], "retcode")


_BLOCKS = "CASE WHEN i = j THEN 6 + s_suppkey % 5 ELSE CASE WHEN j > i THEN 1 ELSE -1 END END"


@query(
    "WITH s AS (SELECT s_suppkey, CAST(6 + s_suppkey % 5 AS DOUBLE) AS d, s_acctbal AS y0, s_acctbal / 2 AS y1, CAST(1 AS DOUBLE) AS y2 FROM supplier), "
    "a AS (SELECT *, d AS a00, 1 AS a01, 1 AS a02, -1 AS a10, d AS a11, 1 AS a12, -1 AS a20, -1 AS a21, d AS a22 FROM s) "
    + " UNION ALL ".join(f"SELECT s_suppkey AS block_id, CAST({k} AS BIGINT) AS i, round({_cramer('y', k)}, 4) AS x, 'Success' AS retcode FROM a" for k in range(3))
)
def block_diagonal_lu(spark, sf_dir):
    """A dense 3 x 3 block for each supplier, each a group."""
    s = table(spark, sf_dir, "supplier")
    at = F.explode(F.sequence(F.lit(0), F.lit(8)))
    e = s.select(F.col("s_suppkey").alias("block_id"), "s_suppkey", at.alias("c")).withColumn("i", F.expr("c div 3")).withColumn("j", F.col("c") % 3)
    e = e.select("block_id", "i", "j", F.expr(_BLOCKS).cast("double").alias("v"))
    b = s.select(F.col("s_suppkey").alias("block_id"), F.posexplode(F.array(F.col("s_acctbal"), F.col("s_acctbal") / 2, F.lit(1.0))).alias("i", "x"))
    return batched.block_diagonal(e, b).select("block_id", "i", F.round("x", 4).alias("x"), "retcode")


_PAIR = "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey % 10) AS DOUBLE) AS sx, CAST(sum((o_orderkey % 10) * (o_orderkey % 10)) AS DOUBLE) AS sxx, sum(o_totalprice) AS sy, sum((o_orderkey % 10) * o_totalprice) AS sxy FROM orders GROUP BY o_custkey"


@query(
    f"WITH s AS ({_PAIR}) SELECT o_custkey, round((sy * sxx - sx * sxy) / nullif(n * sxx - sx * sx, 0) / 731, 4) AS intercept, round((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) / 731, 4) AS slope FROM s"
)
def cramer_2x2_batch(spark, sf_dir):
    return native.grouped_line(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey") % 10, F.col("o_totalprice")).select(
        "o_custkey", F.round(F.col("intercept") / 731, 4).alias("intercept"), F.round(F.col("slope") / 731, 4).alias("slope")
    )


_THREE = "SELECT o_custkey % 50 AS g, CAST(1 AS DOUBLE) AS x0, CAST(o_orderkey % 7 AS DOUBLE) - 3 AS x1, CAST(o_orderkey % 11 AS DOUBLE) - 5 AS x2, o_totalprice / 1000 AS y, o_totalprice AS z FROM orders"


@query(f"WITH t AS ({_THREE}), s AS (SELECT g, {_sums()} FROM t GROUP BY g) SELECT g, {', '.join(f'round({_cramer("y", k)}, 4) AS u{k}' for k in range(3))} FROM s")
def cramer_3x3_batch(spark, sf_dir):
    t = table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS g", "1D AS x0", "cast(o_orderkey % 7 as double) - 3 AS x1", "cast(o_orderkey % 11 as double) - 5 AS x2", "o_totalprice / 1000 AS y")
    s = t.groupBy("g").agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}{j}") for i in range(3) for j in range(3)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"y{i}") for i in range(3)])
    u = native.cramer_3([[F.col(f"a{i}{j}") for j in range(3)] for i in range(3)], [F.col(f"y{i}") for i in range(3)])
    return s.select("g", *[F.round(x, 4).alias(f"u{k}") for k, x in enumerate(u)])


def _small(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    row = lambda *x: F.array(*[c.cast("double") if not isinstance(c, (int, float)) else F.lit(float(c)) for c in x])
    return s.select(k.alias("id"), F.array(row(4 + k % 3, 1, 0), row(1, 5, k % 2), row(0, 1, 6)).alias("a"), row(F.col("s_acctbal") / 7, 1, k % 10).alias("b"))


_SMALL_SQL = (
    "WITH a AS (SELECT s_suppkey AS id, CAST(4 + s_suppkey % 3 AS DOUBLE) AS a00, 1.0 AS a01, 0.0 AS a02, 1.0 AS a10, 5.0 AS a11, CAST(s_suppkey % 2 AS DOUBLE) AS a12, 0.0 AS a20, 1.0 AS a21, 6.0 AS a22, "
    "s_acctbal / 7 AS y0, 1.0 AS y1, CAST(s_suppkey % 10 AS DOUBLE) AS y2 FROM supplier) "
    f"SELECT id, {', '.join(f'round(CAST({_cramer("y", k)} AS DOUBLE), {{digits}}) AS u{k}' for k in range(3))}, 'Success' AS retcode FROM a"
)


def _small_query(kernel: str, digits: int = 4):
    def run(spark, sf_dir):
        return batched.small_batch(_small(spark, sf_dir), kernel).select("id", *[F.round(F.col("u")[k], digits).alias(f"u{k}") for k in range(3)], "retcode")

    return run


for _kernel, _name in (("lu", "static_lu_batch"), ("qr", "static_qr_batch"), ("svd", "static_svd_batch"), ("pivoted_qr", "static_pivoted_qr_batch"), ("normal_cholesky", "static_normal_batch")):
    query(_SMALL_SQL.format(digits=4), _name)(_small_query(_kernel))


@query(_SMALL_SQL.format(digits=0))
def mixed_precision_lu(spark, sf_dir):
    """Single-precision factors, corrected to double precision. Nine digits first: a half that is off by its last bit still rounds away from zero."""
    u = lambda k: F.round(F.round(F.col("u")[k], 9), 0)
    return batched.small_batch(_small(spark, sf_dir), dense.mixed_lu_refined).select("id", *[u(k).alias(f"u{k}") for k in range(3)], "retcode")


# ------------------------------------------------------------------ return codes and rescues

_SINGULAR = [(0, [[1.0, 1.0], [1.0, 1.0]], [1.0, 1.0]), (1, [[0.0, 0.0], [1.0, -1.0]], [1.0, 2.0]), (2, [[2.0, 1.0], [-1.0, 1.0]], [-1.0, 1.0])]


def _codes(kernel: str, safety: bool):
    def run(spark, sf_dir):
        df = spark.createDataFrame(_SINGULAR, "id long, a array<array<double>>, b array<double>")
        return batched.small_batch(df, kernel, safety).select("id", *[(F.round(F.col("u")[k], 6) + 0.0).alias(f"u{k}") for k in range(2)], "retcode", "rescued")

    return run


def _constants(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(x) for x in r) + ')' for r in rows)}) AS t({names})"


_D = lambda x: f"CAST({x} AS DOUBLE)"
_B = lambda x: f"CAST({x} AS BIGINT)"
_TWO_THIRDS = round(-2 / 3, 6)
query(_constants([(_B(0), _D(0.5), _D(0.5), "'Success'", "true"), (_B(1), _D(1), _D(-1), "'Success'", "true"), (_B(2), _D(_TWO_THIRDS), _D(0.333333), "'Success'", "false")], "id, u0, u1, retcode, rescued"), "singular_default_rescue")(_codes("lu", True))
for _kernel, _name, _code in (("lu", "singular_lu_failure", "'Failure'"), ("qr", "singular_qr_failure", "'Failure'"), ("sparse_lu", "singular_sparse_infeasible", "'Infeasible'")):
    query(_constants([(_B(0), _D(0), _D(0), _code, "false"), (_B(1), _D(0), _D(0), _code, "false"), (_B(2), _D(_TWO_THIRDS), _D(0.333333), "'Success'", "false")], "id, u0, u1, retcode, rescued"), _name)(_codes(_kernel, False))


@query("WITH a AS (SELECT s_suppkey AS id, 1.0 AS a0, s_suppkey % 5 + 1 AS a1, s_suppkey % 3 + 2 AS a2, s_acctbal AS b FROM supplier) SELECT id, " + ", ".join(f"round(CAST(a{k} * b / (a0 * a0 + a1 * a1 + a2 * a2) AS DOUBLE), 4) AS u{k}" for k in range(3)) + " FROM a")
def min_norm_wide(spark, sf_dir):
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select(k.alias("id"), F.array(F.array(F.lit(1.0), (k % 5 + 1).cast("double"), (k % 3 + 2).cast("double"))).alias("a"), F.array("s_acctbal").alias("b"))
    return batched.small_batch(df, "min_norm").select("id", *[F.round(F.col("u")[i], 4).alias(f"u{i}") for i in range(3)])


@query(f"WITH t AS ({_X}), c AS (SELECT sum(x1 * y) / sum(x1 * x1) / 2 AS c FROM t) SELECT CAST(i AS BIGINT) AS i, round(c, 3) AS coef, 'Success' AS retcode FROM c, (SELECT unnest([0, 1]) AS i)")
def rank_deficient_tall(spark, sf_dir):
    """One column twice: the shortest solution halves its coefficient."""
    x = F.expr(FEATURES[1])
    u, code = tall.tall_least_squares(table(spark, sf_dir, "lineitem"), [x, x], F.col("l_extendedprice"))
    return _coefficients(spark, u, code.value)


@query("SELECT s_suppkey AS id, round((3.0 * s_acctbal - 1) / 5, 4) AS u0, round((2.0 - s_acctbal) / 5, 4) AS u1, 'Success' AS retcode FROM supplier")
def integer_promotion(spark, sf_dir):
    """Whole-number matrices are cast before anything is chosen."""
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("array(array(2, 1), array(1, 3))").alias("a"), F.array(F.col("s_acctbal"), F.lit(1.0)).alias("b"))
    return batched.small_batch(df, "lu").select("id", *[F.round(F.col("u")[k], 4).alias(f"u{k}") for k in range(2)], "retcode")


# ------------------------------------------------------------------ one system: Krylov, sparse direct, fixed steps

_CHAIN = "SELECT 0 AS k, row_number() OVER (ORDER BY s_suppkey) AS r, CAST(-1 AS DOUBLE) AS dl, CAST(4 AS DOUBLE) AS d, CAST(-1 AS DOUBLE) AS du, s_acctbal / 1000 AS b FROM supplier"
_CHAIN_SQL = _thomas(_CHAIN) + "SELECT r - 1 AS i, round(u, 5) AS u FROM g"


def _chain(spark, sf_dir) -> tuple[Coo, DataFrame]:
    """The tridiagonal matrix 4, -1 of all suppliers in order, and their balances."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    i = (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long")  # one row for each unknown of one system
    b = s.select(i.alias("i"), (F.col("s_acctbal") / 1000).alias("x"))
    near = F.explode(F.array(*[F.struct((F.col("id") + d).alias("j"), F.lit(v).alias("v")) for d, v in ((-1, -1.0), (0, 4.0), (1, -1.0))])).alias("e")
    a = spark.range(n).select(F.col("id").alias("i"), near).select("i", "e.j", "e.v").where(f"j between 0 and {n - 1}")
    return Coo(a, (n, n)), b


def _as_rows(spark, u, digits: int = 5) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(u)], "i long, u double").withColumn("u", F.round("u", digits))


def _krylov_query(name: str, **options):
    def run(spark, sf_dir):
        a, b = _chain(spark, sf_dir)
        made = {k: (v(a) if callable(v) else v) for k, v in options.items()}
        s = solve(LinearProblem(a, b), name, abstol=1e-12, reltol=1e-12, **made)
        return _as_rows(spark, s.u)

    return run


_SQUARE = (
    "cg", "cg_lanczos", "cr", "minres", "minres_qlp", "minares", "symmlq", "gmres", "fgmres", "dqgmres", "fom", "diom", "bicgstab", "cgs", "idrs",
    "qmr", "bilq", "bilqr", "usymlq", "usymqr", "trilqr",
)
for _name in _SQUARE:
    query(_CHAIN_SQL, f"krylov_{_name}")(_krylov_query(_name))
query(_CHAIN_SQL, "jacobi_cg")(_krylov_query("cg", Pl=lambda a: precond.jacobi_of(a.df, a.shape[0])))
_SCALED_SQL = _thomas(_CHAIN) + "SELECT r - 1 AS i, round(u / (1 + 10 * ((r - 1) % 7)), 5) AS u FROM g"


def _scaled(spark, sf_dir) -> tuple[Coo, DataFrame]:
    """The chain with rows and columns scaled by 1 to 61: its condition is some thousands."""
    a, b = _chain(spark, sf_dir)
    d = lambda c: 1 + 10 * (F.col(c) % 7)
    return Coo(a.df.select("i", "j", (F.col("v") * d("i") * d("j")).alias("v")), a.shape), b.select("i", (F.col("x") * d("i")).alias("x"))


def _scaled_query(name: str, preconditioned: bool):
    def run(spark, sf_dir):
        a, b = _scaled(spark, sf_dir)
        options = {"Pl": precond.jacobi_of(a.df, a.shape[0])} if preconditioned else {}
        return _as_rows(spark, solve(LinearProblem(a, b), name, abstol=1e-11, reltol=1e-12, maxiters=20_000, **options).u)

    return run


for _name in ("cg", "cg_lanczos", "cr", "minres", "symmlq", "gmres", "dqgmres", "diom", "bicgstab", "cgs", "idrs", "qmr", "bilq"):
    query(_SCALED_SQL, f"scaled_{_name}_jacobi")(_scaled_query(_name, True))
for _name in ("cg", "minres", "symmlq", "qmr", "bilq"):
    query(_SCALED_SQL, f"scaled_{_name}")(_scaled_query(_name, False))


@query("WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_acctbal AS x FROM supplier), n AS (SELECT count(*) AS n FROM s) SELECT g.i, round(x / 1000, 5) AS u FROM (SELECT unnest(range(100489)) AS i) g, n JOIN s ON s.k = g.i % n.n")
def sparse_poisson(spark, sf_dir):
    """100,489 unknowns of a five-point grid, by the sparse factor: the right-hand side is the grid's product with known values."""
    k = 317
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    own = s.select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long").alias("k"), (F.col("s_acctbal") / 1000).alias("x"))
    u = spark.range(k * k).withColumnRenamed("id", "i").withColumn("k", F.col("i") % n).join(F.broadcast(own), "k").select("i", "x")  # the rows of supplier
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(v).alias("v")) for r, c, v in ((0, 0, 4.0), (0, 1, -1.0), (1, 0, -1.0), (0, -1, -1.0), (-1, 0, -1.0))])
    near = spark.range(k * k).select(F.col("id").alias("i"), F.expr(f"id div {k}").alias("row"), (F.col("id") % k).alias("col"), F.explode(steps).alias("e"))
    inside = near.where(f"row + e.r between 0 and {k - 1} and col + e.c between 0 and {k - 1}")
    a = inside.select("i", F.expr(f"(row + e.r) * {k} + col + e.c").cast("long").alias("j"), F.col("e.v").alias("v"))
    found = solve(LinearProblem(Coo(a, (k * k, k * k)), algebra.matvec(a, u)), "SupernodalLUFactorization")
    return spark.createDataFrame(pa.table({"i": np.arange(k * k), "u": found.u})).withColumn("u", F.round("u", 5))


@query(_CHAIN_SQL)
def distributed_product_cg(spark, sf_dir):
    """Conjugate gradients over products that run in executors, whatever the size."""
    a, b = _chain(spark, sf_dir)
    return _as_rows(spark, solve(LinearProblem(packed_operator(a, local=0), b), "cg", abstol=1e-12, reltol=1e-12).u)


@query(_CHAIN_SQL.replace("SELECT r - 1 AS i, round(u, 5) AS u FROM g", "SELECT r - 1 AS i, round(u, 5) AS u, round(2 * u, 5) AS t FROM g"))
def adjoint_pair(spark, sf_dir):
    """A x = b and A' t = 2 b in one call."""
    a, b = _chain(spark, sf_dir)
    x = np.zeros(a.shape[0])
    for r in b.collect():
        x[r["i"]] = r["x"]
    s = solve(LinearProblem(a, b), "bilqr", abstol=1e-12, reltol=1e-12, c=2 * x)
    return spark.createDataFrame([(k, float(u), float(t)) for k, (u, t) in enumerate(zip(s.u, s.stats["t"]))], "i long, u double, t double").select("i", F.round("u", 5).alias("u"), F.round("t", 5).alias("t"))


def _coupled_query(name: str):
    """x + A y = b and A' x - y = sum of b, where A is a column of ones: y is 0 and x is b."""

    def run(spark, sf_dir):
        b = np.array([r["x"] for r in table(spark, sf_dir, "supplier").orderBy("s_suppkey").select((F.col("s_acctbal") / 1000).alias("x")).collect()])
        n = len(b)
        ones = Operator((n, 1), lambda y: np.full(n, float(y[0])), lambda x: np.array([x.sum()]))
        found = solve(LinearProblem(ones, b), name, abstol=1e-11, reltol=1e-12, c=np.array([b.sum() + n + 1.0]))
        y = float(found.stats["y"][0])
        return spark.createDataFrame([(k, float(x), y) for k, x in enumerate(found.u)], "i long, x double, y double").select("i", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))

    return run


for _name, _y in (("tricg", "-1"), ("trimr", "-1"), ("gpmr", "(n + 1) / (1 - n)")):
    query(f"WITH b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal / 1000 AS b FROM supplier), s AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM b) SELECT i, round(b - CAST({_y} AS DOUBLE), 5) AS x, round(CAST({_y} AS DOUBLE), 5) AS y FROM b, s", f"coupled_{_name}")(_coupled_query(_name))
query(_CHAIN_SQL, "block_jacobi_cg")(_krylov_query("cg", Pl=lambda a: precond.block_jacobi(a.df, a.shape[0], 16)))
query(_CHAIN_SQL, "composed_preconditioner")(_krylov_query("gmres", Pl=lambda a: precond.composed(precond.jacobi(np.full(a.shape[0], 2.0)), precond.jacobi(np.full(a.shape[0], 2.0)))))
query(_CHAIN_SQL, "multigrid_cg")(_krylov_query("AlgebraicMultigridJL"))


@query(_CHAIN_SQL)
def warm_start_resolve(spark, sf_dir):
    """The same system again from the solution before: one step at most."""
    a, b = _chain(spark, sf_dir)
    session = Session(LinearProblem(a, b), "KrylovJL_GMRES", abstol=1e-12, reltol=1e-12, warm_start=WarmStart.PREVIOUS)
    session.solve()
    again = session.solve()
    assert again.iters <= 1, again.iters
    return _as_rows(spark, again.u)


@query(_CHAIN_SQL)
def sparse_direct(spark, sf_dir):
    a, b = _chain(spark, sf_dir)
    return batched.single_task(a.df, b, a.shape, "sparse_lu").select("i", F.round("u", 5).alias("u"))


@query(_CHAIN_SQL)
def symmetric_ldlt(spark, sf_dir):
    a, b = _chain(spark, sf_dir)
    return _as_rows(spark, solve(LinearProblem(a, b), "LDLtFactorization").u)


@query(_CHAIN_SQL)
def cholesky_direct(spark, sf_dir):
    a, b = _chain(spark, sf_dir)
    return _as_rows(spark, solve(LinearProblem(a, b), "CholeskyFactorization").u)


@query(_CHAIN_SQL)
def session_resolve(spark, sf_dir):
    """A first right-hand side, then the one asked for, with one factor."""
    a, b = _chain(spark, sf_dir)
    session = Session(LinearProblem(a, b.select("i", (F.col("x") * 2).alias("x"))))
    session.solve()
    session.b = b
    u = session.solve().u
    assert session.factored == 1
    return _as_rows(spark, u)


@query(_CHAIN_SQL)
def sparse_rhs(spark, sf_dir):
    """Rows of zero may be missing from the right-hand side; the solution has all."""
    a, b = _chain(spark, sf_dir)
    return _as_rows(spark, solve(LinearProblem(a, b.where("x <> 0"))).u)


def _steps_sql(steps: int) -> str:
    s = "WITH b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_acctbal / 1000 AS x FROM supplier), q0 AS (SELECT i, x, CAST(0 AS DOUBLE) AS u FROM b)"
    for k in range(steps):
        s += f", q{k + 1} AS (SELECT i, x, (x + coalesce(lag(u) OVER (ORDER BY i), 0) + coalesce(lead(u) OVER (ORDER BY i), 0)) / 4 AS u FROM q{k})"
    return s + f" SELECT i - 1 AS i, round(u, 6) AS u FROM q{steps}"


@query(_steps_sql(4))
def jacobi_fixed_steps(spark, sf_dir):
    """Four Jacobi sweeps with all vectors in tables: u + (b - A u) / d."""
    a, b = _chain(spark, sf_dir)
    u = b.select("i", F.lit(0.0).alias("x"))
    for _ in range(4):
        u = algebra.axpy(1.0, precond.jacobi_table(a.df, algebra.residual(a.df, u, b)), u)
    return u.select("i", F.round("x", 6).alias("u"))


def _cg_sql(steps: int) -> str:
    s = "WITH s0 AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, CAST(0 AS DOUBLE) AS u, s_acctbal / 1000 AS r, s_acctbal / 1000 AS p FROM supplier)"
    for k in range(steps):
        s += (
            f", q{k} AS (SELECT *, 4 * p - coalesce(lag(p) OVER (ORDER BY i), 0) - coalesce(lead(p) OVER (ORDER BY i), 0) AS q FROM s{k})"
            f", a{k} AS (SELECT sum(r * r) / sum(p * q) AS a, sum(r * r) AS rr FROM q{k})"
            f", t{k} AS (SELECT i, u + a * p AS u, r - a * q AS r, p, rr FROM q{k}, a{k})"
            f", b{k} AS (SELECT sum(r * r) / max(rr) AS b FROM t{k})"
            f", s{k + 1} AS (SELECT i, u, r, r + b * p AS p FROM t{k}, b{k})"
        )
    return s + f" SELECT i - 1 AS i, round(u, 6) AS u FROM s{steps}"


@query(_cg_sql(3))
def cg_fixed_steps(spark, sf_dir):
    """Three steps with all vectors in tables."""
    a, b = _chain(spark, sf_dir)
    return table_cg(a.df, b, 3)[0].select("i", F.round("x", 6).alias("u"))


# ------------------------------------------------------------------ rectangular Krylov

_LINE = "SELECT CAST(i AS BIGINT) AS i, round(u, 5) AS u FROM (SELECT 0 AS i, regr_intercept(c_acctbal / 1000, (c_custkey % 10) / 10) AS u FROM customer UNION ALL SELECT 1, regr_slope(c_acctbal / 1000, (c_custkey % 10) / 10) FROM customer)"


def _line(spark, sf_dir) -> tuple[Coo, DataFrame]:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey")).alias("i"), F.lit(1.0).alias("v0"), ((F.col("c_custkey") % 10) / 10).alias("v1"), (F.col("c_acctbal") / 1000).alias("x"))
    least, most = c.agg(F.min("i"), F.max("i")).first()
    c = c.withColumn("i", F.col("i") - least)
    a = c.select("i", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("j"), F.col(f"v{k}").alias("v")) for k in (0, 1)])).alias("e")).select("i", "e.j", "e.v")
    return Coo(a, (most - least + 1, 2)), c.select("i", "x")


def _line_query(name):
    def run(spark, sf_dir):
        a, b = _line(spark, sf_dir)
        return _as_rows(spark, solve(LinearProblem(a, b), name, reltol=1e-12, abstol=1e-12).u)

    return run


for _name in krylov.LEAST_SQUARES:
    query(_LINE, f"krylov_{_name}")(_line_query(_name))

_WIDE = (
    "WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, (s_suppkey % 10) / 10 AS x FROM supplier), "
    "g AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM a), "
    "w AS (SELECT (10 * ss - 3 * s) / (n * ss - s * s) AS w0, (3 * n - 10 * s) / (n * ss - s * s) AS w1 FROM g) SELECT i, round(w0 + w1 * x, 6) AS u FROM a, w"
)


def _wide_query(name):
    def run(spark, sf_dir):
        s = table(spark, sf_dir, "supplier")
        j = (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long")
        rows = s.select(j.alias("j"), ((F.col("s_suppkey") % 10) / 10).alias("x"))
        a = rows.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(1.0).alias("v")), F.struct(F.lit(1).cast("long").alias("i"), F.col("x").alias("v")))).alias("e"), "j").select("e.i", "j", "e.v")
        u = solve(LinearProblem(Coo(a, (2, s.count())), np.array([10.0, 3.0])), name, reltol=1e-13, abstol=1e-13).u
        return _as_rows(spark, u, 6)

    return run


for _name in krylov.LEAST_NORM:
    query(_WIDE, f"krylov_{_name}")(_wide_query(_name))


# The chain's rows, summed from the first, give each difference of neighbours.
@query(
    "WITH b AS (SELECT i, sin(i) AS x FROM (SELECT unnest(range(100)) AS i)), r AS (SELECT i, x - avg(x) OVER () AS x FROM b), "
    "s AS (SELECT i, sum(x) OVER (ORDER BY i) AS step FROM r), "
    "u AS (SELECT i, -coalesce(sum(step) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM s) "
    "SELECT i, round(u - avg(u) OVER (), 5) AS u FROM u"
)
def neumann_nullspace(spark, sf_dir):
    """A singular chain whose constants are taken out at each step; the solution's mean is 0."""
    n = 100
    i = np.repeat(np.arange(n), 3)
    j = i + np.tile([-1, 0, 1], n)
    v = np.tile([-1.0, 2.0, -1.0], n)
    v[1] = v[-2] = 1.0
    ok = (j >= 0) & (j < n)
    a = Coo(spark.createDataFrame(list(zip(i[ok].tolist(), j[ok].tolist(), v[ok].tolist())), "i long, j long, v double"), (n, n))
    b = np.sin(np.arange(n))
    return _as_rows(spark, solve(LinearProblem(a, b - b.mean()), "PETScAlgorithm", nullspace="constant", reltol=1e-10, maxiters=400, restart=100).u)


# ------------------------------------------------------------------ eigenvalues

_G2 = "WITH t AS (SELECT (l_quantity - 25.5) / 10 AS x, (l_discount - 0.05) * 30 AS y FROM lineitem), g AS (SELECT sum(x * x) / 1000 AS a, sum(x * y) / 1000 AS b, sum(y * y) / 1000 AS d FROM t) "


@query(_G2 + "SELECT CAST(k AS INTEGER) AS k, round((a + d) / 2 + CASE WHEN k = 0 THEN 1 ELSE -1 END * sqrt((a - d) * (a - d) / 4 + b * b), 5) AS lambda_re, CAST(0 AS DOUBLE) AS lambda_im FROM g, (SELECT unnest([0, 1]) AS k)")
def eigen_dense_top2(spark, sf_dir):
    g = algebra.gram(table(spark, sf_dir, "lineitem"), [F.expr("(l_quantity - 25.5D) / 10D"), F.expr("(l_discount - 0.05D) * 30D")])
    s = eigen.solve_eigen(EigenProblem(batched.to_dense(g, (2, 2)) / 1000, count=2))
    return eigen.eigen_rows(spark, *s.u).select("k", F.round("lambda_re", 5).alias("lambda_re"), "lambda_im")


_TARGETS = {"LM": [4, 3, 2, 1], "SM": [1, 2, 3, 4], "LR": [4, 3, 2, 1], "SR": [1, 2, 3, 4], "near 2.2": [2, 3], "B = 2I": [2, 1.5], "top of 8": [8, 7], "near 3.2 of 8": [3, 4]}


@query(_constants([(f"'{t}'", f"CAST({k} AS INTEGER)", _D(v)) for t, vs in _TARGETS.items() for k, v in enumerate(vs)], "target, k, value"))
def eigen_targets(spark, sf_dir):
    four, eight = np.diag([1.0, 2, 3, 4]), np.arange(1.0, 9)
    found = {t: eigen.solve_eigen(EigenProblem(four, target=EigenTarget(t))) for t in ("LM", "SM", "LR", "SR")}
    found["near 2.2"] = eigen.solve_eigen(EigenProblem(four, count=2, shift=2.2))
    found["B = 2I"] = eigen.solve_eigen(EigenProblem(four, B=2 * np.eye(4), count=2))
    found["top of 8"] = eigen.solve_eigen(EigenProblem(None, count=2), "ArnoldiMethodJL", apply=lambda x: eight * x, n=8)
    found["near 3.2 of 8"] = eigen.solve_eigen(EigenProblem(None, count=2, shift=3.2), "JacobiDavidsonJL", apply=lambda x: eight * x, n=8, inverse=lambda x: x / (eight - 3.2))
    rows = [(t, k, float(np.real(v))) for t, s in found.items() for k, v in enumerate(s.u[0])]
    return spark.createDataFrame(rows, "target string, k int, value double").withColumn("value", F.round("value", 6))


# Three vectors, multiplied by the matrix and made orthogonal 1,500 times over.
@query("""
WITH RECURSIVE e AS (SELECT vec_id, k, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
g AS (SELECT a.k AS i, list(s ORDER BY b) AS row FROM (SELECT l.k, r.k AS b, sum(l.x * r.x) AS s FROM e AS l JOIN e AS r USING (vec_id) GROUP BY ALL) AS a GROUP BY a.k),
m AS (SELECT list(row ORDER BY i) AS rows FROM g),
p(t, u, v, w) AS (
  SELECT 0, list_transform(range(1, 65), lambda k: 1.0::DOUBLE + k % 3), list_transform(range(1, 65), lambda k: 1.0::DOUBLE + k % 5), list_transform(range(1, 65), lambda k: 1.0::DOUBLE + k % 7)
  UNION ALL
  SELECT t + 1, u1, v1, list_transform(w0, lambda x: x / sqrt(list_dot_product(w0, w0))) FROM (
    SELECT *, list_transform(range(1, 65), lambda k: w2[k] - list_dot_product(w2, u1) * u1[k] - list_dot_product(w2, v1) * v1[k]) AS w0 FROM (
      SELECT *, list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v1 FROM (
        SELECT *, list_transform(range(1, 65), lambda k: v2[k] - list_dot_product(v2, u1) * u1[k]) AS v0 FROM (
          SELECT t, list_transform(rows, lambda r: list_dot_product(r, v)) AS v2, list_transform(rows, lambda r: list_dot_product(r, w)) AS w2, list_transform(u2, lambda x: x / sqrt(list_dot_product(u2, u2))) AS u1 FROM (
            SELECT t, v, w, rows, list_transform(rows, lambda r: list_dot_product(r, u)) AS u2 FROM p, m WHERE t < 1500)))))
)
SELECT CAST(k AS INTEGER) AS k, round(CASE k WHEN 0 THEN list_dot_product(u, gu) WHEN 1 THEN list_dot_product(v, gv) ELSE list_dot_product(w, gw) END, 4) AS lambda_re, CAST(0 AS DOUBLE) AS lambda_im
FROM (SELECT *, list_transform(rows, lambda r: list_dot_product(r, u)) AS gu, list_transform(rows, lambda r: list_dot_product(r, v)) AS gv, list_transform(rows, lambda r: list_dot_product(r, w)) AS gw FROM p, m WHERE t = 1500), (SELECT unnest([0, 1, 2]) AS k)
""")
def lanczos_embeddings(spark, sf_dir):
    """The largest eigenvalues of the embeddings' Gram matrix, which stays in a table."""
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.max(F.size("embedding"))).first()[0]
    a = Coo(algebra.gram(e, [F.col("embedding")[k] for k in range(n)]), (n, n))
    op = packed_operator(a)
    s = eigen.solve_eigen(EigenProblem(None, count=3), "KrylovKitEigen", apply=op.apply, n=n)
    if not s.ok:
        raise ArithmeticError(f"eigenvalues: {s.retcode.value} after {s.iters} products")
    return eigen.eigen_rows(spark, *s.u).select("k", F.round("lambda_re", 4).alias("lambda_re"), F.round("lambda_im", 4).alias("lambda_im"))


# ------------------------------------------------------------------ adjoints, derivatives, shifts

_A3 = np.array([[4.0, 1, 2], [0, 5, 1], [1, 0, 6]])
_A3_SQL = (
    "WITH s AS (SELECT round(sum(s_acctbal) / 1000, 2) AS t FROM supplier), "
    "a AS (SELECT 4.0 AS a00, 1.0 AS a01, 2.0 AS a02, 0.0 AS a10, 5.0 AS a11, 1.0 AS a12, 1.0 AS a20, 0.0 AS a21, 6.0 AS a22, t AS y0, 1.0 AS y1, 2.0 AS y2, t AS z0, 0.0 AS z1, 1.0 AS z2 FROM s) "
)
_TR = lambda r, c: f"a{c}{r}"


def _balance(spark, sf_dir) -> float:
    return float(table(spark, sf_dir, "supplier").agg(F.round(F.sum("s_acctbal") / 1000, 2)).first()[0])


@query(_A3_SQL + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS i, round(CAST({_cramer('z', k, _TR)} AS DOUBLE), 5) AS u FROM a" for k in range(3)))
def adjoint_solve(spark, sf_dir):
    session = Session(LinearProblem(_A3, np.array([1.0, 1, 1])), "LUFactorization")
    session.solve()
    session.b = np.array([_balance(spark, sf_dir), 0.0, 1.0])
    u = session.solve(adjoint=True).u
    assert session.factored == 1
    return _as_rows(spark, u)


@query(
    _A3_SQL
    + f", u AS (SELECT {', '.join(f'CAST({_cramer("y", k)} AS DOUBLE) AS u{k}, CAST({_cramer("z", k, _TR)} AS DOUBLE) AS l{k}' for k in range(3))} FROM a) "
    + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round(-l{i} * u{j}, 4) AS g FROM u" for i in range(3) for j in range(3) if _A3[i, j])
)
def grad_A_b(spark, sf_dir):
    """The derivative of a sum over u by the stored entries of A: minus the adjoint solution times u, on the pattern."""
    t = _balance(spark, sf_dir)
    u = solve(LinearProblem(_A3, np.array([t, 1.0, 2.0])), "LUFactorization").u
    lam = Session(LinearProblem(_A3, np.array([t, 0.0, 1.0])), "LUFactorization").solve(adjoint=True).u
    rows = lambda x: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    pattern = spark.createDataFrame([(i, j) for i in range(3) for j in range(3) if _A3[i, j]], "i long, j long")
    return diff.grad_a(pattern, rows(lam), rows(u)).select("i", "j", F.round("g", 4).alias("g"))


@query(_constants([(_B(0), _D(0.2), _D(0.6)), (_B(1), _D(0.6), _D(-0.4))], "i, u, du"))
def forward_derivative(spark, sf_dir):
    u, du, _ = diff.forward(np.array([[2.0, 1], [1, 3]]), [np.eye(2)], np.array([1.0, 2]), [np.array([1.0, 0])])
    return spark.createDataFrame([(i, float(u[i]), float(du[0][i])) for i in range(2)], "i long, u double, du double").select("i", F.round("u", 6).alias("u"), F.round("du", 6).alias("du"))


@query(
    "WITH g AS (SELECT s_suppkey AS id, 0.1 * (1 + s_suppkey % 5) AS g, s_acctbal / 1000 AS b FROM supplier), m AS (SELECT *, 2 - 1 / g AS a, 3 - 1 / g AS d FROM g) "
    "SELECT id, round(CAST((d * b - 1) / (a * d - 0.5) AS DOUBLE), 5) AS u0, round(CAST((a - 0.5 * b) / (a * d - 0.5) AS DOUBLE), 5) AS u1 FROM m"
)
def shifted_sweep(spark, sf_dir):
    """(J - I / gamma) u = b for many gammas from one reduction of J, by batches of rows."""
    j = np.array([[2.0, 1.0], [0.5, 3.0]])

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            u = [dense.shifted(j, [g], np.array([b, 1.0]))[0][0] for g, b in zip(pdf["g"], pdf["b"])]
            yield pd.DataFrame({"id": pdf["id"], "u0": [x[0] for x in u], "u1": [x[1] for x in u]})

    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "0.1D * (1 + s_suppkey % 5) AS g", "s_acctbal / 1000 AS b")
    return rows.mapInPandas(run, "id long, u0 double, u1 double").select("id", F.round("u0", 5).alias("u0"), F.round("u1", 5).alias("u1"))


@query("SELECT s_suppkey AS id, [round(s_acctbal / 2, 4), round(s_acctbal / 4, 4), round(1 / 8, 4)] AS u FROM supplier")
def structured_rhs(spark, sf_dir):
    """A record's array is flattened, solved with a diagonal matrix, and packed again."""
    from ..sources.matrix import flatten, repacked

    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal"), F.col("s_acctbal"), F.lit(1.0)).alias("b"))
    d = F.element_at(F.array(F.lit(2.0), F.lit(4.0), F.lit(8.0)), (F.col("i") + 1).cast("int"))
    return repacked(flatten(df, "id", "b").withColumn("x", F.round(F.col("x") / d, 4)), "id", "u")


@query(_thomas(_BY_NATION.format(du=-1)) + "SELECT k AS s_nationkey, r AS i, round(u, 4) AS u FROM g")
def sql_linear_solve(spark, sf_dir):
    """The table function from SQL: each partition is a system."""
    from ..functions.udtf import register

    register(spark)
    rows = _nation_rows(spark, sf_dir, -1.0)
    e = rows.select("s_nationkey", (F.col("i") - 1).alias("i"), F.explode(F.expr("array(named_struct('j', i - 2, 'v', -1D), named_struct('j', i - 1, 'v', 4D), named_struct('j', i, 'v', -1D))")).alias("e"))
    last = rows.groupBy("s_nationkey").agg(F.max("i").alias("n"))
    e = e.select("s_nationkey", "i", "e.j", "e.v").join(last, "s_nationkey").where("j between 0 and n - 1").drop("n")
    both = e.unionByName(rows.select("s_nationkey", (F.col("i") - 1).alias("i"), F.lit(None).cast("long").alias("j"), F.col("b").alias("v")))
    both.select(F.col("s_nationkey").cast("long").alias("system"), "i", "j", "v").createOrReplaceTempView("nation_systems")
    return spark.sql("SELECT cast(system as int) AS s_nationkey, i + 1 AS i, round(u, 4) AS u FROM linear_solve(TABLE(nation_systems) PARTITION BY system)")


# ------------------------------------------------------------------ patterns and structure

_STEPS = "SELECT CAST(event_id % 5 AS INTEGER) AS step, user_id % 12 AS i, length(event_type) % 8 AS j, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS v FROM events"
_STEPS_SQL = f"WITH e AS ({_STEPS}), s AS (SELECT step, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, sum(v) AS v FROM e GROUP BY ALL) "


def _steps(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("cast(event_id % 5 as int) AS step", "user_id % 12 AS i", "cast(length(event_type) % 8 as bigint) AS j", "CASE WHEN event_id % 3 = 0 THEN 0D ELSE value END AS v")
    return e.groupBy("step", "i", "j").agg(F.sum("v").alias("v"))


@query(_STEPS_SQL + "SELECT i, j FROM s GROUP BY i, j HAVING bool_or(v <> 0)")
def pattern_union(spark, sf_dir):
    return algebra.pattern_union(_steps(spark, sf_dir))


@query(f"WITH e AS ({_STEPS}) SELECT i, CAST(j AS BIGINT) AS j, count(*) AS n FROM e WHERE v <> 0 GROUP BY i, j")
def drop_zeros(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id % 12 AS i", "cast(length(event_type) % 8 as bigint) AS j", "CASE WHEN event_id % 3 = 0 THEN 0D ELSE value END AS v")
    return algebra.dropped_zeros(e).groupBy("i", "j").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT l_partkey % 40 AS i, l_suppkey % 40 AS j FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey % 40 AS i, l_suppkey % 40 AS j FROM lineitem WHERE l_linenumber = 2) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS changed")
def pattern_changed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    part = lambda k: li.where(f"l_linenumber = {k}").select((F.col("l_partkey") % 40).alias("i"), (F.col("l_suppkey") % 40).alias("j")).distinct()
    return algebra.pattern_changed(part(1), part(2))


@query(_STEPS_SQL + "SELECT i, j FROM s UNION SELECT j, i FROM s")
def pattern_symmetrised(spark, sf_dir):
    return algebra.symmetrised(_steps(spark, sf_dir))


@query(_STEPS_SQL + ", f AS (SELECT i, j, min(step) AS first FROM s WHERE v <> 0 GROUP BY i, j) SELECT s.step, s.i, s.j FROM s JOIN f USING (i, j) WHERE first <= s.step")
def zero_reduction(spark, sf_dir):
    return reduction.kept_by_step(_steps(spark, sf_dir))


@query("WITH n AS (SELECT count(*) AS n FROM supplier) SELECT 3 * n - 2 AS stored, CAST(0 AS BIGINT) AS zeros, CAST(1 AS BIGINT) AS lower, CAST(1 AS BIGINT) AS upper, n AS on_diagonal, CAST(0 AS BIGINT) AS asymmetric, CAST(0 AS BIGINT) AS weak_columns, 'symmetric tridiagonal' AS kind FROM n")
def structure_detect(spark, sf_dir):
    a, _ = _chain(spark, sf_dir)
    return algebra.structure(a.df, a.shape[0])


# ------------------------------------------------------------------ choices and autotune

_GRID = [(m, n, c) for m, n in ((5, 5), (10, 10), (11, 11), (500, 500), (100, 10), (10, 100)) for c in Condition]


@query(
    "WITH g(m, n, condition) AS (VALUES " + ", ".join(f"({m}, {n}, '{c.name}')" for m, n, c in _GRID) + ") "
    "SELECT CAST(m AS INTEGER) AS m, CAST(n AS INTEGER) AS n, condition, CASE WHEN m = n THEN CASE WHEN condition = 'VERY_ILL' THEN 'QRFactorization' WHEN condition = 'SUPER_ILL' THEN 'SVDFactorization' WHEN m <= 10 THEN 'GenericLUFactorization' ELSE 'LUFactorization' END "
    "WHEN condition = 'WELL' THEN 'NormalCholeskyFactorization' WHEN condition = 'SUPER_ILL' THEN 'SVDFactorization' WHEN m < n THEN 'QRFactorization(ColumnNorm())' ELSE 'QRFactorization' END AS algorithm FROM g"
)
def default_choice(spark, sf_dir):
    return spark.createDataFrame([(m, n, c.name, rules.default_choice(rules.Facts(m, n, condition=c))) for m, n, c in _GRID], "m int, n int, condition string, algorithm string")


_TIMINGS = (
    "SELECT CASE p_partkey % 3 WHEN 0 THEN 'LUFactorization' WHEN 1 THEN 'RFLUFactorization' ELSE 'QRFactorization' END AS algorithm, CASE WHEN p_size % 2 = 0 THEN 'Float64' ELSE 'ComplexF64' END AS eltype, "
    "CAST(p_partkey % 1500 + 1 AS INTEGER) AS size, CASE WHEN p_partkey % 5 < 3 THEN 'dense' ELSE 'sparse' END AS workload, p_retailprice / 100 AS gflops, p_partkey % 11 <> 0 AS success FROM part"
)


def _timings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CASE p_partkey % 3 WHEN 0 THEN 'LUFactorization' WHEN 1 THEN 'RFLUFactorization' ELSE 'QRFactorization' END AS algorithm",
        "CASE WHEN p_size % 2 = 0 THEN 'Float64' ELSE 'ComplexF64' END AS eltype",
        "cast(p_partkey % 1500 + 1 as int) AS size",
        "CASE WHEN p_partkey % 5 < 3 THEN 'dense' ELSE 'sparse' END AS workload",
        "p_retailprice / 100 AS gflops",
        "p_partkey % 11 <> 0 AS success",
    )


@query(f"WITH t AS ({_TIMINGS}) SELECT workload, algorithm, round(avg(gflops), 5) AS avg_gflops, max(gflops) AS max_gflops, count(*) AS n_tests FROM t WHERE success GROUP BY workload, algorithm")
def autotune_summary(spark, sf_dir):
    return autotune.summary(_timings(spark, sf_dir)).withColumn("avg_gflops", F.round("avg_gflops", 5))


@query(f"WITH t AS ({_TIMINGS}) SELECT algorithm, round(avg(gflops), 5) AS avg_gflops FROM t WHERE success GROUP BY algorithm ORDER BY avg(gflops) DESC LIMIT 2")
def autotune_top(spark, sf_dir):
    return autotune.top(_timings(spark, sf_dir), 2).withColumn("avg_gflops", F.round("avg_gflops", 5))


_MEAN = (
    f"WITH t AS ({_TIMINGS}), m AS (SELECT eltype, CASE WHEN size <= 20 THEN 'tiny' WHEN size <= 100 THEN 'small' WHEN size <= 300 THEN 'medium' WHEN size <= 1000 THEN 'large' ELSE 'big' END AS size_class, algorithm, avg(gflops) AS avg_gflops FROM t WHERE success GROUP BY ALL), "
)


@query(
    _MEAN + "r AS (SELECT *, max(CASE WHEN algorithm <> 'RFLUFactorization' THEN avg_gflops END) OVER (PARTITION BY eltype, size_class) AS rival FROM m), "
    "f AS (SELECT * FROM r WHERE NOT (algorithm = 'RFLUFactorization' AND eltype LIKE 'Complex%' AND rival IS NOT NULL AND avg_gflops < 1.2 * rival)) "
    "SELECT eltype, size_class, algorithm, round(avg_gflops, 5) AS avg_gflops FROM (SELECT *, row_number() OVER (PARTITION BY eltype, size_class ORDER BY avg_gflops DESC, algorithm) AS k FROM f) WHERE k = 1"
)
def autotune_best(spark, sf_dir):
    return autotune.best(_timings(spark, sf_dir)).withColumn("avg_gflops", F.round("avg_gflops", 5))


@query(_MEAN + "f AS (SELECT * FROM m WHERE algorithm = 'LUFactorization') SELECT eltype, size_class, algorithm, round(avg_gflops, 5) AS avg_gflops FROM f")
def autotune_best_always_loaded(spark, sf_dir):
    return autotune.best_always_loaded(_timings(spark, sf_dir)).withColumn("avg_gflops", F.round("avg_gflops", 5))


@query(f"WITH t AS ({_TIMINGS}) SELECT DISTINCT algorithm FROM t WHERE NOT success")
def autotune_failures(spark, sf_dir):
    return autotune.failures(_timings(spark, sf_dir))


@query(f"WITH t AS ({_TIMINGS}) SELECT eltype, workload, min(size) AS least_size, max(size) AS most_size FROM t GROUP BY eltype, workload")
def autotune_tested(spark, sf_dir):
    return autotune.tested(_timings(spark, sf_dir))


@query(f"WITH t AS ({_TIMINGS}) SELECT algorithm, size, workload FROM t WHERE size <= 50 UNION ALL SELECT algorithm, size, NULL FROM t WHERE size > 1400")
def autotune_union(spark, sf_dir):
    t = _timings(spark, sf_dir)
    return autotune.merged(t.where("size <= 50").select("algorithm", "size", "workload"), t.where("size > 1400").select("algorithm", "size"))


@query("SELECT size_class, dtype, 'LUFactorization' AS algorithm FROM (SELECT unnest(['tiny', 'small', 'medium', 'large', 'big']) AS size_class), (SELECT unnest(['float', 'double', 'complex']) AS dtype)")
def algorithm_choices(spark, sf_dir):
    """The choice for each size class and type."""
    rows = [(name, t, rules.default_choice(rules.Facts(n, n, dtype=t))) for name, n in (("tiny", 20), ("small", 100), ("medium", 300), ("large", 1000), ("big", 5000)) for t in ("float", "double", "complex")]
    return spark.createDataFrame(rows, "size_class string, dtype string, algorithm string")


__all__ = ["QUERIES", "SQL", "algorithm"]
