"""Solvers that are SQL expressions: diagonal, two and three unknowns, tridiagonal, grouped regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diagonal_solve(d: DataFrame, b: DataFrame) -> DataFrame:
    """(i, u) with u = b / d; a zero divisor gives a null, the mark of a non-finite result."""
    return d.join(b, "i", "left").select("i", F.try_divide(F.coalesce("x", F.lit(0.0)), F.col("d")).alias("u"))


def cramer_2(a: list[list[Column]], b: list[Column]) -> list[Column]:
    det = a[0][0] * a[1][1] - a[0][1] * a[1][0]
    return [F.try_divide(b[0] * a[1][1] - a[0][1] * b[1], det), F.try_divide(a[0][0] * b[1] - b[0] * a[1][0], det)]


def det_3(a: list[list[Column]]) -> Column:
    return (
        a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
        - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
        + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    )


def cramer_3(a: list[list[Column]], b: list[Column]) -> list[Column]:
    det = det_3(a)
    swapped = [[[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)] for k in range(3)]
    return [F.try_divide(det_3(m), det) for m in swapped]


def tridiagonal_solve(rows: DataFrame, key: str | None = None) -> DataFrame:
    """(key, i, u) of tridiagonal systems (key, i, dl, d, du, b), each by elimination as a fold over its sorted rows.

    Systems with different keys are solved side by side; one system is one row of arrays, for
    which the fold takes about n squared copies: some thousand unknowns each. A zero pivot gives nulls.
    """
    keys = [key] if key else []
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "dl", "d", "du", "b"))).alias("r"))
    forward = """aggregate(r, cast(array() as array<struct<c:double,y:double>>), (acc, x) -> concat(acc, array(
        if(size(acc) = 0, named_struct('c', try_divide(x.du, x.d), 'y', try_divide(x.b, x.d)),
           named_struct('c', try_divide(x.du, x.d - x.dl * acc[size(acc) - 1].c),
                        'y', try_divide(x.b - x.dl * acc[size(acc) - 1].y, x.d - x.dl * acc[size(acc) - 1].c))))))"""
    back = """aggregate(reverse(f), cast(array() as array<double>), (acc, x) ->
        concat(array(if(size(acc) = 0, x.y, x.y - x.c * acc[0])), acc))"""
    done = packed.select(*keys, "r", F.expr(forward).alias("f")).select(*keys, "r", F.expr(back).alias("u"))
    return done.select(*keys, F.explode(F.arrays_zip(F.col("r.i").alias("i"), F.col("u"))).alias("z")).select(*keys, F.col("z.i").alias("i"), F.col("z.u").alias("u"))


def grouped_line(table: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    """Per group the least-squares slope and intercept: two unknowns from five sums, nothing leaves the aggregate."""
    t = table.select(F.col(key), x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    s = t.groupBy(key).agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    b0, b1 = cramer_2([[F.col("n"), F.col("sx")], [F.col("sx"), F.col("sxx")]], [F.col("sy"), F.col("sxy")])
    return s.select(key, b0.alias("intercept"), b1.alias("slope"))
