"""Benchmark, summarise, choose and keep the choices: the choices are table queries."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rules
from .algorithms import algorithm

SCHEMA = "algorithm string, eltype string, size int, workload string, gflops double, success boolean, error string"
#: Upper ends of the size classes and their names; the last has none.
CLASSES = ((20, "tiny"), (100, "small"), (300, "medium"), (1000, "large"))
ALWAYS_LOADED = ("LUFactorization", "GenericLUFactorization", "SimpleLUFactorization", "MKLLUFactorization", "AppleAccelerateLUFactorization", "OpenBLASLUFactorization")
#: An algorithm that needs another package is chosen for complex numbers only when this much faster.
COMPLEX_MARGIN = 1.2
#: Element types in results, and what the rules call them.
ELTYPES = {"Float32": "float", "Float64": "double", "ComplexF64": "complex"}


def lu_flops(m: int, n: int) -> int:
    """Operations of an LU factor of an m x n matrix, by the model that published rates use: per step one
    inverse, the sum of the row numbers below the pivot for scaling, and two for each entry updated."""
    k = np.arange(1, min(m, n) + 1)
    return int((1 + (m * (m + 1) - k * (k + 1)) // 2 + 2 * (m - k) * (n - k)).sum())


def measure(spark: SparkSession, sizes=(5, 20, 50, 100, 200), algorithms=("LUFactorization", "QRFactorization", "CholeskyFactorization"), seconds: float = 0.05) -> DataFrame:
    """Timed solves in this process, each held against LU's solution."""
    from .problem import LinearProblem
    from .session import solve

    rows, rng = [], np.random.default_rng(123)
    for n in sizes:
        a = rng.standard_normal((n, n))
        a = a @ a.T + n * np.eye(n)
        b = rng.standard_normal(n)
        want = np.linalg.solve(a, b)
        for name in algorithms:
            error, best, ok = None, np.inf, False
            try:
                end = time.perf_counter() + seconds
                while time.perf_counter() < end:
                    t = time.perf_counter()
                    u = solve(LinearProblem(a, b), name).u
                    best = min(best, time.perf_counter() - t)
                ok = bool(np.linalg.norm(u - want) <= 1e-6 * np.linalg.norm(want))
            except Exception as e:  # noqa: BLE001  a failing algorithm is a row of the result
                error = str(e)
            rows.append((name, "Float64", n, "dense", float(lu_flops(n, n) / best / 1e9) if ok else float("nan"), ok, error))
    return spark.createDataFrame(rows, SCHEMA)


def usable(results: DataFrame) -> DataFrame:
    return results.where(F.col("success") & ~F.isnan("gflops"))


def summary(results: DataFrame) -> DataFrame:
    """Per workload and algorithm: mean, largest and number of the usable rows, best mean first in each workload."""
    out = usable(results).groupBy("workload", "algorithm").agg(F.avg("gflops").alias("avg_gflops"), F.max("gflops").alias("max_gflops"), F.count("*").alias("n_tests"))
    return out.orderBy("workload", F.desc("avg_gflops"))


def top(results: DataFrame, n: int = 5) -> DataFrame:
    return usable(results).groupBy("algorithm").agg(F.avg("gflops").alias("avg_gflops")).orderBy(F.desc("avg_gflops"), "algorithm").limit(n)


def size_class(column: str = "size"):
    c = F.lit("big")
    for most, name in reversed(CLASSES):
        c = F.when(F.col(column) <= most, name).otherwise(c)
    return c


def best(results: DataFrame, external: tuple[str, ...] = ("RFLUFactorization",)) -> DataFrame:
    """(eltype, size_class, algorithm, avg_gflops): the fastest in each class; for complex numbers an ``external`` one only by the margin."""
    mean = usable(results).withColumn("size_class", size_class()).groupBy("eltype", "size_class", "algorithm").agg(F.avg("gflops").alias("avg_gflops"))
    w = Window.partitionBy("eltype", "size_class")
    outside = F.col("algorithm").isin(*external)
    rival = F.max(F.when(~outside, F.col("avg_gflops"))).over(w)
    fair = mean.withColumn("_r", rival).where(~(outside & F.col("eltype").startswith("Complex") & F.col("_r").isNotNull() & (F.col("avg_gflops") < COMPLEX_MARGIN * F.col("_r"))))
    ranked = fair.withColumn("_k", F.row_number().over(w.orderBy(F.desc("avg_gflops"), "algorithm")))
    return ranked.where("_k = 1").select("eltype", "size_class", "algorithm", "avg_gflops")


def best_always_loaded(results: DataFrame) -> DataFrame:
    return best(results.where(F.col("algorithm").isin(*ALWAYS_LOADED)), ())


def failures(results: DataFrame) -> DataFrame:
    """The algorithms with a run that failed."""
    return results.where(~F.col("success")).select("algorithm").distinct()


def tested(results: DataFrame) -> DataFrame:
    """Per element type and workload, the sizes between which it was run."""
    return results.groupBy("eltype", "workload").agg(F.min("size").alias("least_size"), F.max("size").alias("most_size"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two runs, whose columns may differ."""
    return a.unionByName(b, allowMissingColumns=True)


def keep(choices: DataFrame, path: str) -> None:
    """Writes the choices; :func:`adopt` of what :func:`kept` reads makes them the default."""
    choices.coalesce(1).write.mode("overwrite").parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def adopt(choices: DataFrame) -> None:
    """Default choices for dense square matrices are from now on these, one for each type and size class; unknown names are an error."""
    rows = choices.where(F.col("eltype").isin(*ELTYPES)).select("eltype", "size_class", "algorithm").distinct().collect()
    for r in rows:
        algorithm(r["algorithm"])
    rules.PREFERRED.update({(ELTYPES[r["eltype"]], r["size_class"]): r["algorithm"] for r in rows})


def forget() -> None:
    """Default choices are the rule table's own again."""
    rules.PREFERRED.clear()
