"""Matrices and vectors held in tables. Indices start at 0; a missing vector row means 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Coo:
    """Entries (i, j, v); repeated positions add up, stored zeros stay entries. ``symmetric`` names the triangle that holds, L or U."""

    df: DataFrame
    shape: tuple[int, int]
    symmetric: str | None = None
    hermitian: bool = False
    positive: bool = False

    @classmethod
    def of(cls, df: DataFrame, shape: tuple[int, int] | None = None, **kw) -> Coo:
        df = df.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        if shape is None:
            r = df.agg(F.max("i").alias("m"), F.max("j").alias("n")).first()
            shape = ((r["m"] if r["m"] is not None else -1) + 1, (r["n"] if r["n"] is not None else -1) + 1)
        return cls(df, shape, **kw)

    def entries(self) -> DataFrame:
        """All entries, with the other triangle mirrored where one holds."""
        if not self.symmetric:
            return self.df
        own = self.df.where("i >= j" if self.symmetric == "L" else "i <= j")
        return own.unionByName(own.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))

    @property
    def T(self) -> Coo:
        return Coo(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.shape[::-1], {"L": "U", "U": "L", None: None}[self.symmetric])


@dataclass
class DesignView:
    """Rows of any table with feature expressions as columns; as many rows as the table."""

    table: DataFrame
    features: Sequence[str]
    target: str | None = None

    def columns(self) -> list[Column]:
        return [F.expr(e).cast("double") for e in self.features]


@dataclass
class Diagonal:
    df: DataFrame  # (i, d)


@dataclass
class Tridiagonal:
    """(i, dl, d, du) for each row; ``dl`` of the first and ``du`` of the last row are not used."""

    df: DataFrame
    symmetric: bool = False
    bidiagonal: bool = False


@dataclass
class BlockDiagonal:
    """(block_id, i, j, v) with indices inside the block, or one dense block per row."""

    df: DataFrame


@dataclass
class SmallBatch:
    """One system in each row: (id, a array<array<double>>, b array<double>)."""

    df: DataFrame


@dataclass
class Operator:
    """A matrix known by what it does: functions on NumPy vectors."""

    shape: tuple[int, int]
    apply: Callable[[np.ndarray], np.ndarray]
    adjoint: Callable[[np.ndarray], np.ndarray] | None = None


@dataclass
class Shifted:
    """J - I / gamma, not assembled."""

    J: Any
    gamma: float


#: Kinds that the default choice knows, for arrays.
ARRAY_KINDS = ("hermitian", "symmetric", "banded", "almost_banded", "block_diagonal", "static", "tridiagonal", "symtridiagonal", "bidiagonal", "diagonal", "unknown")


@dataclass
class Structured:
    """An array whose structure is known: ``kind`` is one of ``ARRAY_KINDS``."""

    a: Any
    kind: str
    square_blocks: bool = True

    def __post_init__(self):
        if self.kind not in ARRAY_KINDS:
            raise ValueError(f"no such kind: {self.kind}")
        self.a = np.asarray(self.a)


def vector(spark: SparkSession, x: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")


def coo_rows(spark: SparkSession, a) -> DataFrame:
    """Entries of a small array, zeros included where they are stored as entries."""
    a = np.asarray(a)
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "i long, j long, v double")


def flatten(df: DataFrame, key: str, value: str) -> DataFrame:
    """A record's array column as a vector: (key, i, x)."""
    return df.select(key, F.posexplode(value).alias("i", "x")).select(key, F.col("i").cast("long"), F.col("x").cast("double"))


def repacked(df: DataFrame, key: str, value: str) -> DataFrame:
    """The inverse of :func:`flatten`, in order of ``i``."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(value))
