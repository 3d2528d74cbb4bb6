"""Least squares over tall tables: a QR factor of each task's rows, then of the factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..functions import dense
from ..plans.problem import RetCode

#: Relative size of a pivot at which a column counts as dependent on the others.
DEPENDENT = 1e-13


def joined(blocks, p: int) -> np.ndarray:
    """The triangular factor of blocks of rows. Factors of equally many blocks are joined, as in a binary
    counter: rounding grows with the logarithm of their number, where one factor after another would lose digits."""
    held: list[tuple[int, np.ndarray]] = []
    for a in blocks:
        level, r = 0, np.linalg.qr(a, mode="r")
        while held and held[-1][0] == level:
            level, r = level + 1, np.linalg.qr(np.vstack([held.pop()[1], r]), mode="r")
        held.append((level, r))
    r = np.zeros((0, p))
    while held:
        r = np.linalg.qr(np.vstack([held.pop()[1], r]), mode="r")
    return r


def tall_r(table: DataFrame, columns: list[Column]) -> np.ndarray:
    """The triangular factor of all rows. A task sends one factor; beyond 256 tasks they are joined in a further stage."""
    p = len(columns)

    def stacked(blocks):
        r = joined(blocks, p)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["r"])

    def rows(batches):
        yield from stacked(np.column_stack([np.asarray(b.column(k).cast(pa.float64()).fill_null(float("nan"))) for k in range(p)]) for b in batches if b.num_rows)

    def factors(batches):
        yield from stacked(np.frombuffer(x).reshape(-1, p) for b in batches for x in b.column(0).to_pylist())

    parts = table.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).na.drop().mapInArrow(rows, "r binary")
    n = parts.rdd.getNumPartitions()
    if n > 256:
        parts = parts.repartition(64).mapInArrow(factors, "r binary")
    return joined((np.frombuffer(x).reshape(-1, p) for x in parts.toArrow()["r"].to_pylist()), p)  # 256 factors at most, from one job


def tall_least_squares(table: DataFrame, features: list[Column], target: Column, kernel: str = "qr") -> tuple[np.ndarray, RetCode]:
    """Coefficients without forming X'X; where columns depend on each other, the shortest. ``kernel`` solves with the triangular factor."""
    n = len(features)
    r = tall_r(table, [*features, target])
    if len(r) < n:
        r = np.vstack([r, np.zeros((n - len(r), n + 1))])
    d = np.abs(np.diag(r[:n, :n]))
    # Rounding over many rows leaves a dependent column's pivot above the bound for one small matrix.
    if d.min() <= DEPENDENT * d.max():
        return dense.pivoted_qr(r[:n, :n], r[:n, n], DEPENDENT)
    return dense.KERNELS[kernel](r[:n, :n], r[:n, n])
