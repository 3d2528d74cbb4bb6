"""SQL surface: a table function that solves one system per partition of its input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="system bigint, i bigint, u double, retcode string")
class LinearSolve:
    """Rows (system, i, j, v) are entries and rows (system, i, null, v) the right-hand side.

    Use PARTITION BY system, or WITH SINGLE PARTITION for one system: rows split over tasks would be parts of systems.
    """

    def __init__(self):
        self.entries, self.rhs, self.system = [], [], None

    def eval(self, row):
        self.system = row["system"]
        if row["j"] is None:
            self.rhs.append((row["i"], row["v"]))
        else:
            self.entries.append((row["i"], row["j"], row["v"]))

    def terminate(self):
        from tessera.operators.batched import rescued

        if not self.entries:
            return
        m = 1 + max([e[0] for e in self.entries] + [r[0] for r in self.rhs])
        n = 1 + max(e[1] for e in self.entries)
        a, b = np.zeros((m, n)), np.zeros(m)
        for i, j, v in self.entries:
            a[i, j] += v
        for i, v in self.rhs:
            b[i] += v
        u, code, _ = rescued("lu" if m == n else "pivoted_qr", a, b)
        for i, x in enumerate(u):
            yield self.system, i, float(x), code.value


def register(spark: SparkSession) -> None:
    spark.udtf.register("linear_solve", LinearSolve)
