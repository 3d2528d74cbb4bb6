"""Derivatives of solutions: adjoint (reverse) on the stored pattern, and forward with partial derivatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..plans.problem import RetCode


def grad_b(lam: DataFrame) -> DataFrame:
    """The derivative by b is the adjoint solution itself."""
    return lam.select("i", F.col("x").alias("g"))


def grad_a(pattern: DataFrame, lam: DataFrame, u: DataFrame) -> DataFrame:
    """(i, j, g) with g = - lambda_i u_j at the stored positions only."""
    out = pattern.select("i", "j").join(lam.select("i", F.col("x").alias("l")), "i").join(u.select(F.col("i").alias("j"), F.col("x").alias("u")), "j")
    return out.select("i", "j", (-F.col("l") * F.col("u")).alias("g"))


def forward(a: np.ndarray, da: list[np.ndarray], b: np.ndarray, db: list[np.ndarray]):
    """(u, [du for each partial]) with all partials as further right-hand sides of one matrix.

    Square: A du = db - dA u. Otherwise, for least squares: A'A du = A'db + dA'(b - A u) - A'dA u.
    """
    if a.shape[0] == a.shape[1]:
        u, code = dense.lu(a, b)
        if not code.ok:
            return u, [np.zeros_like(u) for _ in da], code
        du, code = dense.lu(a, np.column_stack([d - m @ u for m, d in zip(da, db)]))
        return u, list(du.T), code
    u, code = dense.pivoted_qr(a, b)
    r = b - a @ u
    rhs = [a.T @ d + m.T @ r - a.T @ (m @ u) for m, d in zip(da, db)]
    du, code = dense.pivoted_qr(a.T @ a, np.column_stack(rhs))
    return u, list(du.T), code if isinstance(code, RetCode) else RetCode.SUCCESS
