"""Sources interleaved to target weights by Pfair scheduling.

Each source's documents form blocks of ``BLOCK`` in order. With a weight w of W in all, block j
(from 0) of a source is released at floor(j W / w) and is due at ceil((j + 1) W / w). In each slot
the released block with the earliest deadline runs. As the weights add up to W, every block
meets its deadline, so at any slot a source has run less than one block more or less than
its target. The schedule repeats after W slots, with the weights' common divisor taken out. It is
computed on the driver, for one period or until the last block has run, whichever is sooner:
``ROOTS`` times the number of sources at most where the weights are not given.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_bucket, saved, tasks, unit

BLOCK = 8
#: The weight of the largest source where weights are not given.
ROOTS = 1_000
OWN = ("block", "slot", "mix_at")


def schedule(weights: list[int], blocks: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The period, and source, j and slot of the blocks of one: those of ``blocks`` blocks a source that run in it."""
    if min(weights, default=1) < 1:
        raise ValueError("a source's weight is 1 at least")
    common = math.gcd(*weights)
    weights = [w // common for w in weights]
    period = sum(weights)
    end = min(period, max((-(-b * period // w) for w, b in zip(weights, blocks)), default=0))
    sources, js, slots = (np.zeros(sum(min(b, w) for w, b in zip(weights, blocks)), np.int64) for _ in range(3))
    waiting = [(0, i, 0) for i in range(len(weights))]  # by release
    ready: list[tuple[int, int, int]] = []  # by deadline
    n = 0
    for t in range(end):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[i]), i, j))
        _, i, j = heapq.heappop(ready)
        if j < blocks[i]:
            sources[n], js[n], slots[n] = i, j, t
            n += 1
        heapq.heappush(waiting, ((j + 1) * period // weights[i], i, j + 1))
    return period, sources, js, slots


def _roots(counts: DataFrame) -> DataFrame:
    """Weights in proportion to the root of a source's rows, ``ROOTS`` for the largest and 1 at least."""
    most = F.max("c").over(Window.partitionBy())  # of a row for each source
    root = F.floor(ROOTS * F.sqrt(F.col("c").cast("double") / most.cast("double")))
    return counts.select("src", F.greatest(root, F.lit(1)).cast("long").alias("w"))


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``block`` (long), ``slot`` (long: when that block runs) and ``mix_at`` (long).

    All rows stay; ``mix_at`` is unique and sorts the table into the mix. Weights are
    integers from 1 by source; without them it follows the root of its rows (``_roots``).
    Sources without a weight get 1; a null source is a source. When a source runs out, the
    others go on in their slots. Within a source the order is ascending doc_id, nulls
    first, then the text's hash; repeated rows follow one another. Columns with the names
    of the results are replaced. An empty table gives an empty result.

    The weights are kept exactly, and the period follows from them: given weights should be small numbers.
    A source's rows are numbered inside ranges of doc_id, so that no task gets a whole source.
    Any number of sources is taken; their names, weights and counts are held on the driver.
    """
    docs = docs.drop(*OWN)
    if weights is None:
        return _mixed(docs, _roots, block).select("_row.*", *OWN)
    named = {("n" if k is None else f"s:{k}"): int(v) for k, v in weights.items()}
    given = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("src")] if named else F.lit(None)
    return _mixed(docs, lambda counts: counts.select("src", F.coalesce(given, F.lit(1)).cast("long").alias("w")), block).select("_row.*", *OWN)


def _mixed(docs: DataFrame, law, block: int) -> DataFrame:
    """``_row``, a struct of all columns of ``docs``, and those of ``OWN``, with weights ``w`` by ``src`` from ``law``, a function of the rows ``c`` by ``src``."""
    spark = docs.sparkSession
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s:"), F.col("source").cast("string"))).alias("src"),
        F.col("doc_id").alias("_id"),
        (F.xxhash64("text") if "text" in docs.columns else F.lit(0)).alias("_h"),
    )
    packed = packed.withColumn("_b", range_bucket(packed, "_id", tasks(spark), unit(F.col("_h"))))
    per = packed.groupBy("src", "_b").agg(F.count("*").alias("_c"))
    counts = per.groupBy("src").agg(F.sum("_c").alias("c"))
    sources = counts.join(law(counts), "src").orderBy("src").collect()
    ws = [r["w"] for r in sources]
    period, at, js, slots = schedule(ws, [-(-r["c"] // block) for r in sources])
    common = math.gcd(*ws) or 1
    by_source = np.split(slots[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at, minlength=len(sources)))[:-1])
    rows = [(r["src"], r["w"] // common, own.tolist()) for r, own in zip(sources, by_source)]
    known = spark.createDataFrame(rows, "src string, n long, slots array<long>")
    table = saved(known.select("src", F.posexplode("slots").alias("j", "slot")), "slots")  # the slots of one period at most
    shares_of = known.select("src", "n")
    before = Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("src", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0")).join(shares_of, "src")
    inside = Window.partitionBy("src", "_b").orderBy(F.col("_id").asc_nulls_first(), "_h")
    return (
        packed.withColumn("_i", F.row_number().over(inside).cast("long") - 1)
        .join(starts, ["src", "_b"])
        .withColumn("_at", F.col("_c0") + F.col("_i"))
        .withColumn("_block", F.expr(f"_at div {block}"))
        .withColumn("j", F.col("_block") % F.col("n"))
        .join(table, ["src", "j"])
        .withColumn("_slot", F.col("slot") + F.expr("_block div n") * period)
        .select("_row", F.col("_block").alias("block"), F.col("_slot").alias("slot"), (F.col("_slot") * block + F.col("_at") % block).alias("mix_at"))
    )


def in_mix_order(docs: DataFrame) -> DataFrame:
    """``docs`` range-partitioned and sorted into the mix, with its own columns, whatever their names.

    Null ids come first in their source, and rows alike in id and text follow one another. An empty table stays empty.
    """
    n = tasks(docs.sparkSession)
    return _mixed(docs, _roots, BLOCK).repartitionByRange(n, "mix_at").sortWithinPartitions("mix_at").select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


# The law played slot by slot: of the blocks released, the one that is due first; no period, no gcd.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's:' || source END AS src FROM documents),
c AS (SELECT src, count(*) AS n FROM d GROUP BY src),
e AS (SELECT src, n, greatest(1, CAST(floor({ROOTS} * sqrt(CAST(n AS DOUBLE) / CAST(max(n) OVER () AS DOUBLE))) AS BIGINT)) AS w FROM c),
f AS (SELECT src, w, CAST(sum(w) OVER () AS BIGINT) AS total, (n + {BLOCK} - 1) // {BLOCK} AS blocks FROM e),
l AS (SELECT list(src ORDER BY src) AS names, list(w ORDER BY src) AS ws, max(total) AS total, max((blocks * total + w - 1) // w) AS last FROM f),
run(t, done, pick, j) AS (
  SELECT CAST(0 AS BIGINT), list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, done[p]
  FROM (SELECT t, done, list_min(list_transform(list_filter(range(1, len(ws) + 1),
          lambda i: (done[i] * total) // ws[i] <= t),
          lambda i: {{'due': ((done[i] + 1) * total + ws[i] - 1) // ws[i], 'i': i}})).i AS p
        FROM run, l WHERE t < last)),
b AS (SELECT doc_id, source, src, row_number() OVER (PARTITION BY src ORDER BY doc_id) - 1 AS at FROM d)
SELECT b.doc_id, b.source, CAST(b.at // {BLOCK} AS BIGINT) AS block, CAST(run.t - 1 AS BIGINT) AS slot, CAST((run.t - 1) * {BLOCK} + b.at % {BLOCK} AS BIGINT) AS mix_at
FROM b, l JOIN run ON run.t > 0 WHERE l.names[run.pick] = b.src AND run.j = b.at // {BLOCK}
"""
