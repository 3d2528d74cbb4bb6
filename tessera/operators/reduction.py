"""Stored zeros over a sequence of matrices: which positions to keep, as a small state machine over aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.problem import Zeros

#: Share of stored zeros from which AUTO acts, and of those becoming other than zero from which it drops per matrix.
START_SHARE, SWITCH_SHARE = 0.1, 0.5


@dataclass
class ZeroReduction:
    """``reduced(a)`` returns the entries to factor. Modes: off, pending (all zero so far), union, per_matrix."""

    zeros: Zeros = Zeros.AUTO
    mode: str | None = None
    stored: int = 0
    first_zeros: int = 0
    kept: DataFrame | None = None

    def _counts(self, a: DataFrame) -> tuple[int, int]:
        r = a.agg(F.count("*").alias("n"), F.sum((F.col("v") == 0).cast("long")).alias("z")).first()
        return r["n"], r["z"] or 0

    def reduced(self, a: DataFrame) -> DataFrame:
        n, z = self._counts(a)
        if self.mode in (None, "pending"):
            self.stored = n
            if self.zeros is Zeros.NONE:
                self.mode = "off"
            elif self.zeros is Zeros.PRESENT:
                self.mode = "per_matrix"
            elif self.zeros is Zeros.AUTO and n and z == n:
                self.mode = "pending"
            else:
                self.mode = "union" if self.zeros is Zeros.PERSISTENT or n and z / n >= START_SHARE else "off"
                self.first_zeros = z
                self.kept = a.where("v <> 0").select("i", "j").distinct() if self.mode == "union" else None
                if self.mode == "union":
                    self.kept = self.kept.persist()
            return a.where("v <> 0") if self.mode == "per_matrix" else a if self.mode != "union" else a.join(self.kept, ["i", "j"])
        if self.mode == "off":
            return a
        if self.mode == "per_matrix":
            return a.where("v <> 0")
        if self.zeros is Zeros.PERSISTENT and n != self.stored:
            raise ValueError(f"{n} stored entries, where the first matrix had {self.stored}")
        new = self.kept.union(a.where("v <> 0").select("i", "j")).distinct().persist()
        count = new.count()
        self.kept.unpersist()
        woken = count - (self.stored - self.first_zeros)
        self.kept = new
        if count >= n:
            self.mode = "off"
            return a
        if self.zeros is Zeros.AUTO and self.first_zeros and woken / self.first_zeros > SWITCH_SHARE:
            self.mode = "per_matrix"
            return a.where("v <> 0")
        return a.join(new, ["i", "j"])


def kept_by_step(steps: DataFrame) -> DataFrame:
    """(step, i, j) for each step: the union of all positions other than zero up to it, from each one's first step."""
    first = steps.where("v <> 0").groupBy("i", "j").agg(F.min("step").alias("first"))
    return steps.select("step", "i", "j").join(first, ["i", "j"]).where("first <= step").select("step", "i", "j")
