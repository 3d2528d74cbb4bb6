"""Exact top-k inner products by MaxScore over shards.

A vector's dimensions are a query's terms; a shard keeps one posting row for each dimension (the values
of its vectors) with the largest and smallest value. A term's score lies between the bounds that the
query's component gives it. Terms are taken by falling spread of their bounds. With a threshold from the
best k so far, the terms whose spreads together cannot lift a vector from below it are
non-essential: essential postings are traversed for all vectors, and the others are probed only for
vectors whose bound still reaches the threshold. Vectors are in ascending id, so an
equal score from a later one never wins. The shards' lists are merged by a grouped rank.

Vectors are dealt to shards, queries to blocks, both of bounded size. A vector goes to its shard once, and
each block of queries to every shard, which is the stated query set against all rows; a task holds
one shard and one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tasks

SHARD = 8_192
QUERIES_AT_ONCE = 1_024
FIRST = 512
K = 5

_OUT = "query_id long, vec_id long, score long"


class Shard:
    """Posting rows of one shard: integer vectors by ascending id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        most = float(np.abs(vectors).max(initial=0))
        self.limit = most
        self.rows = np.ascontiguousarray(vectors[order].T.astype(np.float64))
        self.high, self.low = self.rows.max(axis=1, initial=-np.inf), self.rows.min(axis=1, initial=np.inf)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors with another id, by falling score and then rising id."""
        if self.limit * float(np.abs(q).sum()) >= 2.0**53:  # beyond exact doubles: whole numbers throughout
            scores = np.array([sum(int(a) * int(b) for a, b in zip(q, v)) for v in self.rows.T], object)
            keep = np.flatnonzero(self.ids != query_id)
            best = sorted(keep, key=lambda i: (-scores[i], self.ids[i]))[:k]
            return self.ids[best], np.array([scores[i] for i in best], np.int64)
        at_high, at_low = q * self.high, q * self.low
        upper, lower = np.maximum(at_high, at_low), np.minimum(at_high, at_low)
        terms = np.argsort(lower - upper, kind="stable")
        rest = np.concatenate([np.cumsum(upper[terms][::-1])[::-1], [0.0]])
        seen = min(FIRST, len(self.ids))
        ids, scores = self._best(self.ids[:seen], q @ self.rows[:, :seen], query_id, k)
        if seen == len(self.ids):
            return ids, scores.astype(np.int64)
        threshold = scores[-1] if len(scores) == k else -np.inf
        # Essential: the terms before the first place from which the spreads that are left can't make up for
        # a vector's being at its lowest everywhere before it.
        floor = np.concatenate([[0.0], np.cumsum(lower[terms])])
        split = int(np.argmax(floor + rest <= threshold)) if (floor + rest <= threshold).any() else len(terms)
        split = max(split, min(len(terms), 8))
        part = q[terms[:split]] @ self.rows[terms[:split], seen:]
        live = np.flatnonzero(part + rest[split] > threshold) + seen
        part = part[live - seen]
        for start in range(split, len(terms), 8):
            if not len(live):
                break
            stop = min(start + 8, len(terms))
            own = terms[start:stop]
            part = part + q[own] @ self.rows[np.ix_(own, live)]
            ok = part + rest[stop] > threshold
            live, part = live[ok], part[ok]
        more, values = self._best(self.ids[live], part, query_id, k)
        return self._best(np.concatenate([ids, more]), np.concatenate([scores, values]), query_id, k, exact=True)

    @staticmethod
    def _best(ids, scores, query_id, k, exact=False):
        keep = ids != query_id
        ids, scores = ids[keep], scores[keep]
        if len(ids) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= cut
            ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order].astype(np.int64) if exact else scores[order]


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): the floor of ``scale`` times each component; rows with a null or non-finite part are left out, repeated rows are one."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("vec_id").isNotNull()
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.where(ok).select("vec_id", v.alias("v")).dropDuplicates(["vec_id", "v"])


def _runs(batches):
    """((s, b), rows) of consecutive rows that agree in both, from sorted batches."""
    held, last = [], None
    for batch in batches:
        s, b = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        cut = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (b[1:] != b[:-1])])) if batch.num_rows else []
        for x, y in zip(cut, [*cut[1:], batch.num_rows]):
            key = int(s[x]), int(b[x])
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(x, y - x))
    if held:
        yield last, pa.Table.from_batches(held)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best ``vectors`` for each row of ``queries``, both (vec_id, v).

    Ties go to the smaller id; all are returned where there are fewer; a query's own id takes no part.
    Vectors of another length than the query's take no part either. Empty tables give an empty result.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // QUERIES_AT_ONCE))
    deal = lambda df, parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")
    left = vectors.select("vec_id", "v", deal(vectors, shards).alias("s"), F.lit(-1).alias("b"))
    right = queries.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), deal(queries, blocks).alias("b"))

    def search(batches):
        shard, own = {}, None
        for (s, b), table in _runs(batches):
            ids, sizes = np.array(table["vec_id"]), np.array(table["v"].combine_chunks().value_lengths())
            flat = np.array(table["v"].combine_chunks().flatten())
            starts = np.concatenate([[0], np.cumsum(sizes)])
            if b < 0:
                shard, own = {}, s
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    shard[size] = Shard(ids[rows], flat[starts[rows][:, None] + np.arange(size)])
            elif own == s:
                out: list[list] = [[], [], []]
                for i in range(len(ids)):
                    if sizes[i] in shard:
                        got, scores = shard[sizes[i]].top(ids[i], flat[starts[i] : starts[i + 1]].astype(np.float64), k)
                        out[0] += [int(ids[i])] * len(got)
                        out[1] += [int(x) for x in got]
                        out[2] += [int(x) for x in scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    dealt = left.unionByName(right).repartition(tasks(vectors.sparkSession), "s").sortWithinPartitions("s", "b")
    found = dealt.mapInArrow(search, _OUT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
