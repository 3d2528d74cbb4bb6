"""A distributed matrix for Krylov methods: entries packed into blocks of rows, one job for each product."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import DRIVER_UNKNOWNS, LOCAL_ENTRIES
from ..sources.matrix import Coo, Operator


def local_array(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = df.select("i", "j", "v").toArrow()
    return tuple(np.asarray(t[c].combine_chunks()) if t.num_rows else np.zeros(0, np.float64 if c == "v" else np.int64) for c in ("i", "j", "v"))


def _product(shape, i, j, v):
    return lambda x: np.bincount(i, v * x[j], shape[0]) if len(i) else np.zeros(shape[0])


def _pack(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        i, j, v = (np.asarray(t[c].combine_chunks()) for c in ("i", "j", "v"))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i, j, v)], ["i", "j", "v"])


def packed_operator(a: Coo, local: int | None = None) -> Operator:
    """``a`` as functions on NumPy vectors.

    Up to ``local`` entries (LOCAL_ENTRIES), which are counted first, are kept on the driver. More stay in
    executors as blocks of rows; a product broadcasts the vector, whose length is checked, and
    gathers one partial sum for each row that a block has.
    """
    if max(a.shape) > DRIVER_UNKNOWNS:
        raise ValueError(f"{max(a.shape)} unknowns; vectors on the driver take {DRIVER_UNKNOWNS}. Use table_cg")
    entries = a.entries()
    local = LOCAL_ENTRIES if local is None else local
    if local and entries.limit(local + 1).count() <= local:
        i, j, v = local_array(entries)
        return Operator(a.shape, _product(a.shape, i, j, v), _product(a.shape[::-1], j, i, v))
    spark = a.df.sparkSession
    blocks = max(8, entries.rdd.getNumPartitions())
    packed = entries.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).repartition(blocks, "i").mapInArrow(_pack, "i binary, j binary, v binary").persist()

    def apply(x: np.ndarray, rows: str = "i", cols: str = "j") -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def multiply(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    i, j = np.frombuffer(r[rows], np.int64), np.frombuffer(r[cols], np.int64)
                    own, at = np.unique(i, return_inverse=True)
                    y = np.bincount(at, np.frombuffer(r["v"]) * shared.value[j], len(own))
                    yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["i", "y"])

        out = np.zeros(a.shape[0] if rows == "i" else a.shape[1])
        parts = packed.mapInArrow(multiply, "i binary, y binary").toArrow()  # one job; a partial sum for each row that a block has
        for i, y in zip(parts["i"].to_pylist(), parts["y"].to_pylist()):
            out += np.bincount(np.frombuffer(i, np.int64), np.frombuffer(y), len(out))
        shared.unpersist()
        return out

    return Operator(a.shape, apply, lambda y: apply(y, "j", "i"))


def table_cg(a: DataFrame, b: DataFrame, steps: int, tolerance: float = 0.0) -> tuple[DataFrame, int, float]:
    """Conjugate gradients with all vectors in tables (i, x), for more unknowns than the driver takes.

    Each step is one join with the matrix and one checkpoint of the four vectors side by side, so the
    plan stays short and a lost executor costs a reread.
    """
    from .algebra import matvec

    spark = a.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    else:
        raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
    state = b.select("i", F.lit(0.0).alias("u"), F.col("x").alias("r"), F.col("x").alias("p")).checkpoint()
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    limit, k = tolerance * tolerance * rr, 0
    while k < steps and rr > limit:
        q = matvec(a, state.select("i", F.col("p").alias("x"))).withColumnRenamed("x", "q")
        both = state.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))).checkpoint()
        pq = both.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not pq:
            break
        alpha = rr / pq
        stepped = both.select("i", (F.col("u") + alpha * F.col("p")).alias("u"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new = stepped.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        state = stepped.select("i", "u", "r", (F.col("r") + (new / rr) * F.col("p")).alias("p")).checkpoint()
        rr, k = new, k + 1
    return state.select("i", F.col("u").alias("x")), k, rr**0.5
