"""Matrix algebra as joins and aggregates; Catalyst chooses the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, x) of A x from entries (i, j, v): an equi-join on j and partial sums by row. Rows without entries are missing, which means 0."""
    return a.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def matvec_transpose(a: DataFrame, y: DataFrame) -> DataFrame:
    return matvec(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), y)


def filled(x: DataFrame, index: DataFrame) -> DataFrame:
    """``x`` with a 0 for each ``i`` of ``index`` that it hasn't got."""
    return index.select("i").join(x, "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


#: Features up to which the products are columns of one aggregate; more would make its generated code too long.
WIDE = 16


def _wide_gram(table: DataFrame, xs: list[Column], n: int) -> DataFrame:
    """Each task's X'[X y] from NumPy, summed by position."""
    import numpy as np
    import pyarrow as pa

    p = len(xs)

    def partial(batches):
        total = np.zeros((n, p))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(-1, p)
            total += x[:, :n].T @ x
        i, j = np.divmod(np.arange(n * p), p)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    rows = table.select(F.array(*xs).alias("x")).where(~F.exists("x", lambda e: e.isNull()))
    return rows.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram(table: DataFrame, features: list[Column], target: Column | None = None) -> DataFrame:
    """(i, j, v) of X'X and, at j = number of features, X'y: one pass with partial aggregation."""
    xs = [f.cast("double") for f in features] + ([target.cast("double")] if target is not None else [])
    n = len(features)
    if len(xs) > WIDE:
        return _wide_gram(table, xs, n)
    pairs = [(i, j) for i in range(n) for j in range(i, len(xs))]
    one = table.select(*[x.alias(f"x{k}") for k, x in enumerate(xs)]).agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.coalesce(F.col(f"s{i}_{j}"), F.lit(0.0)).alias("v")) for i, j in pairs]
    cells += [F.struct(F.lit(j).cast("long").alias("i"), F.lit(i).cast("long").alias("j"), F.coalesce(F.col(f"s{i}_{j}"), F.lit(0.0)).alias("v")) for i, j in pairs if i < j < n]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def sparse_gram(a: DataFrame) -> DataFrame:
    """A'A of entries (i, j, v), joined on the row."""
    b = a.select("i", F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(b, "i").groupBy(F.col("j").alias("i"), F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def residual(a: DataFrame, u: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) of b - A u."""
    return b.join(matvec(a, u).withColumnRenamed("x", "y"), "i", "full").select("i", (F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("x"))


def norm(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnRenamed("x", "y"), "i").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha x + y."""
    both = x.select("i", (F.lit(float(alpha)) * F.col("x")).alias("x")).unionByName(y.select("i", "x"))
    return both.groupBy("i").agg(F.sum("x").alias("x"))


# ------------------------------------------------------------------ patterns


def pattern_union(steps: DataFrame) -> DataFrame:
    """Of a sequence of matrices (step, i, j, v): positions that have ever been other than 0."""
    return steps.groupBy("i", "j").agg(F.bool_or(F.col("v") != 0).alias("on")).where("on").select("i", "j")


def dropped_zeros(a: DataFrame) -> DataFrame:
    return a.where(F.col("v") != 0)


def symmetrised(a: DataFrame) -> DataFrame:
    """Positions of A + A'."""
    return a.select("i", "j").union(a.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def pattern_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many positions only one of two matrices stores."""
    both = a.select("i", "j", F.lit(1).alias("s")).unionByName(b.select("i", "j", F.lit(-1).alias("s")))
    return both.groupBy("i", "j").agg(F.sum("s").alias("s")).where("s <> 0").agg(F.count("*").alias("changed"))


def structure(a: DataFrame, n: int) -> DataFrame:
    """One row of facts about entries (i, j, v) of an n x n matrix: stored, zeros, bandwidths, diagonal, triangular, symmetric, needs matching."""
    off = a.where(F.col("v") != 0)
    facts = a.agg(
        F.count("*").alias("stored"),
        F.sum((F.col("v") == 0).cast("long")).alias("zeros"),
        F.coalesce(F.max(F.when((F.col("v") != 0) & (F.col("i") > F.col("j")), F.col("i") - F.col("j"))), F.lit(0)).alias("lower"),
        F.coalesce(F.max(F.when((F.col("v") != 0) & (F.col("j") > F.col("i")), F.col("j") - F.col("i"))), F.lit(0)).alias("upper"),
        F.sum(((F.col("i") == F.col("j")) & (F.col("v") != 0)).cast("long")).alias("on_diagonal"),
    )
    mirrored = off.select("i", "j", "v").unionByName(off.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v")))
    broken = mirrored.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0").agg(F.count("*").alias("asymmetric"))
    weak = (
        a.groupBy("j").agg(F.max(F.abs("v")).alias("m"), F.max(F.when(F.col("i") == F.col("j"), F.abs("v"))).alias("d"))
        .where(F.coalesce("d", F.lit(0.0)) < 0.01 * F.col("m")).agg(F.count("*").alias("weak_columns"))
    )
    return facts.crossJoin(broken).crossJoin(weak).withColumn(  # three rows of one each
        "kind",
        F.when((F.col("lower") == 0) & (F.col("upper") == 0), "diagonal")
        .when((F.col("lower") == 0) & (F.col("upper") == 1) | (F.col("lower") == 1) & (F.col("upper") == 0), "bidiagonal")
        .when((F.col("lower") == 1) & (F.col("upper") == 1), F.when(F.col("asymmetric") == 0, "symmetric tridiagonal").otherwise("tridiagonal"))
        .when((F.col("lower") == 0) | (F.col("upper") == 0), "triangular")
        .when(F.greatest("lower", "upper") * 4 <= n, "banded")
        .when(F.col("asymmetric") == 0, "symmetric")
        .otherwise("general"),
    )
