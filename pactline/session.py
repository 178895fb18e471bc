"""Session helpers: recommended settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot flow's partition even where that costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state on local disk instead of the executor's heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Can only be set before the session is there. Recording the call site of every
# expression takes most of the planning time.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the recommended settings to a session that is about to be made."""
    for key, value in {**RECOMMENDED, **AT_START}.items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that exists; sizes stay the cluster's."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def settle(frame: DataFrame) -> DataFrame:
    """Compute once and keep the rows in the shared folder, where they outlive executors."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(frame.sparkSession, "settled"))
    return frame.checkpoint()


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/pactline/{label}-{uuid.uuid4().hex}"
