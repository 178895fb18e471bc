"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most keys that are broadcast because many rows have them.
HOT_KEYS = 1024
#: Buckets of a sieve: the most rows that it broadcasts.
SIEVE_BUCKETS = 1 << 20
#: Bytes of rows that a task hands to Python at once; a buffer of them is doubled as it grows, outside the heap.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs begun here hand BATCH_BYTES to Python at once; the session's own setting comes back after."""
    before = spark.conf.get(_BATCH_SETTING)
    keep_batches_small(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def keep_batches_small(spark: SparkSession) -> None:
    """As small_batches, from now on: for a job that the caller begins on a frame that is handed back."""
    spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def written(frame: DataFrame) -> DataFrame:
    """Write once, read from then on: lost executors take nothing with them."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    with small_batches(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a query begun here go when it ends: for tables that are written, and read from then on."""
    before = spark.conf.get(_FREE_SETTING, "false")
    spark.conf.set(_FREE_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SETTING, before)


def boxed(docs: DataFrame, key: Column, row: Column) -> DataFrame:
    """doc_id, row, and doc with all columns of the caller, so that none of their names can clash; ``doc.*`` gives them back."""
    return docs.select(key.alias("doc_id"), row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def sieved(rows: DataFrame, asked: DataFrame, key: str = "row") -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among asked, and those whose key is surely not; no row moves.

    A sieve before a shuffle, not instead of it. What is broadcast are the buckets that
    have a key, SIEVE_BUCKETS at most; with more keys than that it lets more pass.
    """
    bucket = lambda c: F.pmod(c, F.lit(SIEVE_BUCKETS)).cast("int")
    buckets = written(asked.select(bucket(F.col(key)).alias("_bucket")).distinct())
    inside = bucket(rows[key]) == buckets["_bucket"]
    return rows.join(F.broadcast(buckets), inside, "left_semi"), rows.join(F.broadcast(buckets), inside, "left_anti")


def hot_and_rest(rows: DataFrame, classes: DataFrame, key: str, class_key: str) -> DataFrame:
    """rows joined with their class (class_key, n rows, ...), which each of them has.

    Classes of more than 1 / HOT_KEYS of all rows, so fewer than HOT_KEYS of them, are
    broadcast, and their rows stay where they are; the others meet by a shuffle.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(classes.filter(F.col("n") * HOT_KEYS > total).drop("n"))
    rest = classes.filter(F.col("n") * HOT_KEYS <= total).drop("n")
    cold = rows.join(hot, rows[key] == hot[class_key], "left_anti")
    return rows.join(hot, rows[key] == hot[class_key]).unionByName(cold.join(rest, cold[key] == rest[class_key]))
