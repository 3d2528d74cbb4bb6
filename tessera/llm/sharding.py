"""Contiguous shards of nearly equal bytes, by DataFrame functions only.

Rows get bucket numbers that ascend with the order of the table. One aggregate gives the bytes
of each bucket, a prefix sum over these few totals gives each bucket's start, and a window
inside the bucket gives each row's start. A row belongs to the shard in whose equal share of
all bytes the row's middle lies, so that each cut is off by half a row at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_bucket, tasks

N_SHARDS = 16


def byte_shards(rows: DataFrame, size: str, bucket: str, order: Sequence[str], n_shards: int = N_SHARDS) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    ``size`` names a column of row sizes above 0, ``bucket`` one that ascends with ``order``.
    Ties in ``order`` are cut in any order; rows alike in all of ``order`` and ``size`` are
    interchangeable. A bucket is sorted in one task (and spills); it holds a share of the rows
    that the caller chose, whatever the sizes or sources. No rows in, none out. Columns named
    ``shard`` or ``slot`` are replaced.
    """
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]).alias("_row"),
        F.col(bucket).alias("_b"),
        F.col(size).cast("long").alias("_n"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    ascending = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))] + [F.col("_n")]
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = packed.groupBy("_b").agg(F.sum("_n").alias("_bytes"), F.count("*").alias("_rows")).select(
        "_b",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(whole).alias("_all"),
    )
    inside = Window.partitionBy("_b").orderBy(*ascending)
    placed = (
        packed.withColumn("_start", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .withColumn("_index", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(starts), "_b")  # one row for each bucket, so one for about a million rows
        .withColumn("_twice", 2 * (F.col("_bytes0") + F.col("_start")) + F.col("_n"))
        .select(
            "_row",
            (F.col("_rows0") + F.col("_index")).alias("_at"),
            F.least(F.lit(n_shards - 1), F.expr(f"cast((_twice * {n_shards}) div (2 * _all) as int)")).alias("shard"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows
        "_row.*", "shard", (F.col("_at") - F.col("_first")).alias("slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Shard, slot, size and checksum of each document, in ascending doc_id order.

    Size is the text's UTF-8 bytes and 1; a null text has 1 byte and the checksum of no bytes.
    Null ids come first. Repeated rows are placed one after another. An empty table gives an
    empty result; other columns are not read.
    """
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    slim = slim.withColumn("_bucket", range_bucket(slim, "doc_id", 4 * tasks(docs.sparkSession), F.col("text_crc32") / F.lit(2.0**32)))
    return byte_shards(slim, "size", "_bucket", ["doc_id", "text_crc32"], n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# crc32 by its definition: the table of 256 remainders from the reflected polynomial, then a fold over bytes.
SQL = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents),
bytes AS (
  SELECT DISTINCT text, list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: CAST('0x' || h AS BIGINT)) AS bs
  FROM d WHERE text <> ''),
crc AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) AS c
  FROM bytes, tab),
p AS (
  SELECT d.doc_id, d.size, CAST(coalesce(crc.c, 0) AS BIGINT) AS text_crc32,
    sum(d.size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER () AS total
  FROM d LEFT JOIN crc ON d.text = crc.text),
s AS (
  SELECT *, CAST(least(15, ((2 * upto - size) * 16) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
