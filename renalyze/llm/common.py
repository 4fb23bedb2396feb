"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, prepare

# Arrow batches are bounded by rows and bytes: a batch of long texts must fit
# a Python worker beside the executor's heap.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

ASCII_SPACE = " \t\n\x0b\x0c\r"          # [\x20\x09-\x0D]


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for k, v in ARROW_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts lineage,
    fixes generated ids, and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two 64-bit hashes that name a (doc_id, text) pair.  Rows equal in both
    columns share the key (their results are equal too); nulls are allowed."""
    i, t = F.col(doc_id), F.col(text)
    return [F.xxhash64(i, t).alias("_k1"), F.xxhash64(t, i, F.lit(1)).alias("_k2")]


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of those that repeat both doc_id and text (null text as empty):
    the greatest by its columns in order, so the choice does not depend on the
    partitioning.  Only rows of repeated doc_ids are touched."""
    again = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return docs
    repeated = docs["doc_id"].eqNullSafe(again["_id"])
    keys = ["doc_id", F.sha2(text_of().cast("binary"), 256).alias("_sha")]
    best = (docs.join(again, repeated, "left_semi").groupBy(*keys).agg(F.max(F.struct(*docs.columns)).alias("_row")).select("_row.*"))
    return docs.join(again, repeated, "left_anti").unionByName(best)


def crc_rest(doc_id: Column, modulus: int, when_null: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; ``when_null`` for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(when_null))
