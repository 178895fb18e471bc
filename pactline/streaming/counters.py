"""Row and duplicate counts of files as they arrive.

Every trigger writes its own partial count under its batch number, replacing
what an interrupted attempt of the same batch may have left. Totals are sums
over these rows: no trigger looks at old data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactline.operators.measures import key_columns

COUNTS = "n bigint, epoch bigint"


def stream_rows(
    spark: SparkSession, path: str, schema: str, source_format: str = "csv", **options: str
) -> DataFrame:
    """Rows of files that appear below a path; text files have a header line."""
    reader = spark.readStream.schema(schema).format(source_format)
    if source_format == "csv":
        reader = reader.option("header", "true").option("escape", '"')
    return reader.options(**options).load(path)


def _write_count(rows: DataFrame, epoch: int, out: str) -> None:
    rows.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def count_rows(rows: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Count rows per trigger; runs over what is there and ends, unless told otherwise."""
    return (
        rows.writeStream.foreachBatch(lambda batch, epoch: _write_count(batch, epoch, out))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def count_distinct_keys(
    rows: DataFrame, keys: Sequence[str], out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Count keys the first time they are seen.

    The state holds each key once, spread over the shuffle partitions, with the
    times of the first and the last trigger it came in. A key is new while the
    two are the same. As an aggregation it is reduced before the shuffle, so a
    key that fills a trigger arrives as one row per task. Null keys equal each
    other.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    seen = (
        rows.select(*key_columns(rows, keys), F.current_timestamp().alias("__seen"))
        .groupBy(*names)
        .agg(F.min("__seen").alias("first_seen"), F.max("__seen").alias("last_seen"))
    )

    def write(batch: DataFrame, epoch: int) -> None:
        _write_count(batch.where("first_seen = last_seen"), epoch, out)

    return (
        seen.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def row_total(spark: SparkSession, out: str) -> DataFrame:
    counts = spark.read.schema(COUNTS).parquet(out)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))


def unique_key_totals(spark: SparkSession, rows_out: str, keys_out: str) -> DataFrame:
    """Total rows, and the rows beyond the first of each key."""
    distinct = row_total(spark, keys_out).scalar()
    return row_total(spark, rows_out).select(
        "total_rows", (F.col("total_rows") - distinct).alias("duplicate_count")
    )
