"""Helpers shared by the corpus operators: shared storage, words, byte hashes, ordered buckets."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one batch of rows for Python, but for one longer row.
BATCH_BYTES = str(4 << 20)

# --------------------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that does not name one (tests) gets a folder of our own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "tessera")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, below one of this application that is deleted when it ends."""
    top = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    _file_system(spark, top).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(top))
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def deleted(df: DataFrame) -> None:
    """Deletes the files of a saved table that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _file_system(spark, folder).delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage ends there."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Groups that a join sends to all rows: those with at least a part in ``HEAVY`` of the rows, so no more than these.
HEAVY = 2_000


def split_join(rows: DataFrame, groups: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``groups``, a saved table with a row for each value of ``on`` and its number of rows.

    Rows of the heaviest groups stay where they are: these groups, ``HEAVY`` at most, are
    broadcast. The others are joined by a shuffle, in which no value has more than a part in ``HEAVY`` of the rows.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    least = max(1_000, -(-total // HEAVY))
    heavy = groups.where(F.col(count) >= least)
    few = heavy.limit(HEAVY + 1).collect()
    if not few:
        return rows.join(groups, on)
    few = rows.sparkSession.createDataFrame(few, groups.schema)
    return rows.join(F.broadcast(few), on).unionByName(rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(groups.where(F.col(count) < least), on))


def ranked(rows: DataFrame, pair: list[str], weight: str) -> DataFrame:
    """Of each value of ``pair`` that ties: its rank in sorted order and ``n``, the sum of ``weight``. Saved, so that a rank stays what it is."""
    ties = rows.groupBy(*pair).agg(F.sum(weight).alias("n")).where("n > 1")
    ordered = ties.repartitionByRange(tasks(rows.sparkSession), *pair).sortWithinPartitions(*pair)
    return saved(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding by bytes the batches that its session sends to Python: rows hold texts of any length."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(name, BATCH_BYTES)
    return df


# --------------------------------------------------------------------------- words

# A word is a run of ASCII digits, ASCII letters and code points above U+007F; A-Z count as a-z.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; none of a null text."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


# --------------------------------------------------------------------------- hashes

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(31)


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair of names; equal pairs get equal names everywhere."""
    out = left * _M1
    out ^= out >> _S
    out += right * _M2
    out ^= out >> _S
    out *= _M1
    out ^= out >> _S
    return out


def scrambled(x: np.ndarray) -> np.ndarray:
    out = x * _M2
    out ^= out >> _S
    out *= _M1
    out ^= out >> _S
    return out


# --------------------------------------------------------------------------- ordered buckets


#: Cuts of the first split into ranges, and the rows that one bucket should have at most.
MOST_CUTS, BUCKET_ROWS = 255, 1 << 20


def unit(h: Column) -> Column:
    """A signed 64-bit hash as a number from 0 to 1 in the same order."""
    return h.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def _place(x: Column, cuts: list, low: int = 0) -> Column:
    """How many of the ascending ``cuts`` are not above ``x``, plus ``low``: a binary search as a tree of conditions."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    return F.when(x >= F.lit(cuts[middle]), _place(x, cuts[middle + 1 :], low + middle + 1)).otherwise(_place(x, cuts[:middle], low))


def range_bucket(df: DataFrame, column: str, n: int, tie: Column | None = None) -> Column:
    """A bucket number for ``column`` (whole numbers or null), ascending with it, then with ``tie`` (0 to 1); nulls come first.

    Quantiles, ``MOST_CUTS`` at most, cut the column into ranges, and each range is cut evenly again
    so that buckets have about ``BUCKET_ROWS`` rows. Rows that are null, or equal a cut (such as an id
    of very many rows), are cut by ``tie``. Only the quantiles reach the driver; the bounds are literals,
    so a recomputed task gets the same buckets.
    """
    n = max(2, min(n, MOST_CUTS + 1))
    got = df.agg(F.percentile_approx(F.col(column), [i / n for i in range(1, n)], F.lit(20 * n)).alias("q"), F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    x, cuts = F.col(column), sorted(set(got["q"] or []))
    if not cuts:
        cuts = [0]
    by_tie = F.least(F.floor(tie * F.lit(-(-got["c"] // BUCKET_ROWS))), F.lit((1 << 20) - 1)) if tie is not None and got["c"] > BUCKET_ROWS else F.lit(0)
    place = _place(x, cuts)
    pieces = -(-got["c"] // (n * BUCKET_ROWS))
    inside = F.lit(0)
    if pieces > 1:
        ends = [got["lo"], *cuts, got["hi"]]
        low, high = (F.element_at(F.array(*[F.lit(float(c)) for c in e]), place + 1) for e in (ends[:-1], ends[1:]))
        part = F.floor((x.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * F.lit(pieces))
        inside = F.greatest(F.lit(0), F.least(part, F.lit(pieces - 1)))
    cut = x.isin(cuts)
    code = F.when(x.isNull(), F.lit(-1)).otherwise(2 * place + (~cut).cast("int"))
    return code.cast("long") * F.lit(1 << 20) + F.when(x.isNull() | cut, by_tie).otherwise(inside).cast("long")


# --------------------------------------------------------------------------- Arrow batches


def chunks(batches, target: int = 1 << 20, rows: int = 256):
    """Dicts of column lists from Arrow batches, cut when column ``text`` reaches about ``target`` bytes."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows).to_pydict()
            texts = part["text"]
            start = 0
            for i, t in enumerate(texts):
                size += len(t) if t else 1
                if size >= target:
                    for k, v in part.items():
                        held.setdefault(k, []).extend(v[start : i + 1])
                    yield held
                    held, size, start = {}, 0, i + 1
            if start < len(texts):
                for k, v in part.items():
                    held.setdefault(k, []).extend(v[start:])
    if held and held["text"]:
        yield held
