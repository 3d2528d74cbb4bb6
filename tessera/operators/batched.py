"""Many small systems at once: a task solves whole groups with NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.sparse import SparseFactor
from ..plans.problem import RetCode


def rescued(kernel: str | Callable, a, b, safety: bool = True, residual_safety: bool = False, abstol=0.0, reltol=1.5e-8):
    """The kernel's solution, or the pivoted QR's where it fails, isn't finite or leaves too large a residual. A retry that isn't asked for gives the code."""
    solve = dense.KERNELS[kernel] if isinstance(kernel, str) else kernel
    u, code = solve(a, b)
    bad_residual = code.ok and residual_safety and a.shape[0] == a.shape[1] and not dense.residual_ok(a, u, b, abstol, reltol)
    if code.ok and np.isfinite(u).all() and not bad_residual:
        return u, code, False
    if not safety:
        return u, RetCode.RESIDUAL_FAILURE if bad_residual else code, False
    u, code = dense.pivoted_qr(a, b)
    return u, code, True


def small_batch(df: DataFrame, kernel: str | Callable = "lu", safety: bool = False) -> DataFrame:
    """(id, u array<double>, retcode, rescued) of the systems (id, a, b), one in each row.

    Systems of equal shape in a batch go to LAPACK in one call; those that it refuses are solved one by one.
    """

    def solve(batches):
        for batch in batches:
            d = batch.to_pydict()
            n = len(d["id"])
            us, codes, saved = [None] * n, [None] * n, [False] * n
            shapes: dict[tuple[int, int], list[int]] = {}
            for k, a in enumerate(d["a"]):
                shapes.setdefault((len(a), len(a[0]) if a else 0), []).append(k)
            for (m, c), rows in shapes.items():
                a = np.array([d["a"][k] for k in rows], float).reshape(len(rows), m, c)
                b = np.array([d["b"][k] for k in rows], float).reshape(len(rows), m)
                try:
                    if kernel != "lu" or m != c:
                        raise np.linalg.LinAlgError
                    u = np.linalg.solve(a, b[..., None])[..., 0]
                    good = np.isfinite(u).all(axis=1)
                except np.linalg.LinAlgError:
                    u, good = None, np.zeros(len(rows), bool)
                for x, k in enumerate(rows):
                    if good[x]:
                        us[k], codes[k] = u[x].tolist(), RetCode.SUCCESS.value
                    else:
                        v, code, saved[k] = rescued(kernel, a[x], b[x], safety)
                        us[k], codes[k] = v.tolist(), code.value
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), pa.array(us, pa.list_(pa.float64())), pa.array(codes, pa.string()), pa.array(saved, pa.bool_())], ["id", "u", "retcode", "rescued"]
            )

    return df.select(F.col("id").cast("long"), "a", "b").mapInArrow(solve, "id long, u array<double>, retcode string, rescued boolean")


def block_diagonal(blocks: DataFrame, b: DataFrame, kernel: str = "lu", safety: bool = False) -> DataFrame:
    """(block_id, i, x, retcode) for blocks (block_id, i, j, v) and right-hand sides (block_id, i, x): each block is a group."""
    rows = b.groupBy("block_id").agg(F.collect_list(F.struct("i", "x")).alias("b"))
    entries = blocks.groupBy("block_id").agg(F.collect_list(F.struct("i", "j", "v")).alias("e"))

    def solve(pdfs):
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                rhs = [] if r.b is None else list(r.b)
                n = 1 + max([int(x["i"]) for x in r.e] + [int(x["i"]) for x in rhs])
                c = 1 + max(int(x["j"]) for x in r.e)
                a, y = np.zeros((n, c)), np.zeros(n)
                for x in r.e:
                    a[int(x["i"]), int(x["j"])] += x["v"]
                for x in rhs:
                    y[int(x["i"])] += x["x"]
                u, code, _ = rescued(kernel if n == c else "pivoted_qr", a, y, safety)
                out += [(r.block_id, i, float(v), code.value) for i, v in enumerate(u)]
            yield pd.DataFrame(out, columns=["block_id", "i", "x", "retcode"])

    kind = blocks.schema["block_id"].dataType.simpleString()
    return entries.join(rows, "block_id", "left").mapInPandas(solve, f"block_id {kind}, i long, x double, retcode string")


def grouped_least_squares(table: DataFrame, key: str, features: list[str], target: str, kernel: str = "normal_cholesky") -> DataFrame:
    """(key, coef, retcode) per group from the groups' Gram matrices, which are aggregated before anything is gathered."""
    xs = [F.expr(e).cast("double").alias(f"x{i}") for i, e in enumerate([*features, target])]
    n = len(features)
    pairs = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    sums = table.select(key, *xs).groupBy(key).agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs])

    def solve(pdfs):
        for pdf in pdfs:
            out = []
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n)])
                u, code, _ = rescued("cholesky" if kernel == "normal_cholesky" else "lu", g[:, :n], g[:, n])
                out.append((r[key], u.tolist(), code.value))
            yield pd.DataFrame(out, columns=[key, "coef", "retcode"])

    return sums.mapInPandas(solve, f"{key} {table.schema[key].dataType.simpleString()}, coef array<double>, retcode string")


def to_dense(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A matrix that placement has found small enough, on the driver."""
    from .packed import local_array

    i, j, v = local_array(df)
    out = np.zeros(shape)
    np.add.at(out, (i, j), v)
    return out


def single_task(df: DataFrame, b: DataFrame, shape: tuple[int, int], kernel: str = "lu", safety: bool = True) -> DataFrame:
    """(i, u, retcode) of one system in one executor's task, which placement has found small enough."""
    rows = df.select("i", "j", F.col("v").cast("double"), F.lit(None).cast("double").alias("x")).unionByName(b.select("i", F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("v"), F.col("x").cast("double")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(shape[0])
        e, r = pdf[pdf["j"].notna()], pdf[pdf["j"].isna()]
        if kernel == "sparse_lu" and shape[0] == shape[1]:
            np.add.at(y, r["i"].to_numpy(int), r["x"].to_numpy(float))
            u, code = SparseFactor(e["i"].to_numpy(int), e["j"].to_numpy(int), e["v"].to_numpy(float), shape[0]).solve(y)
            return pd.DataFrame({"i": np.arange(len(u)), "u": u, "retcode": code.value})
        a = np.zeros(shape)
        np.add.at(a, (e["i"].to_numpy(int), e["j"].to_numpy(int)), e["v"].to_numpy(float))
        np.add.at(y, r["i"].to_numpy(int), r["x"].to_numpy(float))
        u, code, _ = rescued(kernel, a, y, safety)
        return pd.DataFrame({"i": np.arange(len(u)), "u": u, "retcode": code.value})

    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(solve, "i long, u double, retcode string")


__all__ = ["block_diagonal", "grouped_least_squares", "rescued", "single_task", "small_batch", "to_dense"]
