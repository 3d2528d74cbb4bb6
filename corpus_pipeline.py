"""A corpus made ready for training: each stage keeps whole rows of what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import range_bucket, saved, tasks, unit
from tessera.llm.decontamination import without_contaminated
from tessera.llm.jaccard import classed
from tessera.llm.mixing import in_mix_order
from tessera.llm.sharding import byte_shards
from tessera.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learnt from the labels rejects go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row stays: with the least doc_id, null ids last, then the least hash of its text.

    Documents without words are in no class and all stay. Rows are told apart by doc_id and the
    text's hash.
    """
    key = [F.col("doc_id").isNull().alias("_z"), F.coalesce("doc_id", F.lit(0)).alias("_d")]
    names = ["_z", "_d", "_h"]
    found = saved(classed(docs).where("root is not null").select("root", *key, F.col("h").alias("_h")), "classes")
    least = found.groupBy("root").agg(F.min(F.struct(*names)).alias("_least"))
    out = saved(found.join(least, "root").where(F.struct(*names) != F.col("_least")).select(*names).distinct(), "copies")
    twice = saved(found.groupBy(*names).agg(F.count("*").alias("c")).where("c > 1").select(*names), "repeats")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key, F.xxhash64("text").alias("_h"))
    kept = rows.join(out, names, "left_anti")
    if twice.limit(1).count():
        once = kept.join(twice, names, "left_anti")
        kept = once.unionByName(kept.join(twice, names, "left_semi").dropDuplicates(names))
    return kept.select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, in an order that interleaves the sources by their target weights."""
    return in_mix_order(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, shard and slot: contiguous pieces of the table's order of nearly equal bytes.

    The order is that of the files and of the rows in each, so each shard has the mix of the stage before.
    Where ``docs`` isn't read from files, it is that of doc_id.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot")]
    if docs.inputFiles():
        name = F.col("_metadata.file_name")  # part-<number>-..., which counts further than five digits
        rows = docs.select(*own, size, F.concat(F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 19, "0"), name).alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return byte_shards(rows, "size", "_file", ["_row"]).drop("_file", "_row")
    rows = docs.select(*own, size)
    rows = rows.withColumn("_bucket", range_bucket(rows, "doc_id", tasks(spark), unit(F.xxhash64("text")))).withColumn("_h", F.xxhash64("text"))
    return byte_shards(rows, "size", "_bucket", ["doc_id", "_h"]).drop("_bucket", "_h")


STAGES = [
    ("toxicity", toxicity),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The model of the first stage is learnt, which SQL can't express; tests hold ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each saved before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, "stage")
    return docs
