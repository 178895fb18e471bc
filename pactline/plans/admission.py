"""Which submissions become runs: idempotence, validation, concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline import model
from pactline.plans.registry import latest_contracts


def first_submissions(submissions: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per (pipeline, run_id): the stored run if there is one, else the first submission.

    ``origin`` is stored or new. Stored runs and submissions meet in a single
    aggregation, with partial minima before the shuffle.
    """
    stored = runs.select(*model.RUN_KEY, F.lit(0).alias("rank"), "seq")
    offered = submissions.select(*model.RUN_KEY, F.lit(1).alias("rank"), "seq")
    return (
        stored.unionByName(offered)
        .groupBy(*model.RUN_KEY)
        .agg(
            F.min("rank").alias("rank"),
            F.min(F.when(F.col("rank") == 0, F.col("seq"))).alias("stored_seq"),
            F.min(F.when(F.col("rank") == 1, F.col("seq"))).alias("offered_seq"),
        )
        .select(
            *model.RUN_KEY,
            F.when(F.col("rank") == 0, "stored").otherwise("new").alias("origin"),
            F.coalesce("stored_seq", "offered_seq").alias("seq"),
        )
    )


def new_submissions(submissions: DataFrame, runs: DataFrame) -> DataFrame:
    """Submissions to evaluate: first of their run id and not stored yet."""
    firsts = submissions.groupBy(*model.RUN_KEY).agg(F.min("seq").alias("seq"))
    chosen = submissions.join(firsts, [*model.RUN_KEY, "seq"], "left_semi")
    return chosen.join(runs.select(*model.RUN_KEY), model.RUN_KEY, "left_anti")


def running_counts(runs: DataFrame) -> DataFrame:
    return (
        runs.where(F.col("status") == model.RUNNING)
        .groupBy("pipeline")
        .agg(F.count(F.lit(1)).alias("running"))
    )


def admit(submissions: DataFrame, runs: DataFrame, limit: int = model.MAX_CONCURRENT_RUNS) -> DataFrame:
    """Add ``running``, ``admitted`` and ``reason``; a full pipeline admits nothing."""
    running = F.coalesce("running", F.lit(0).cast("bigint"))
    refused = F.format_string(
        "Concurrent run limit exceeded for '%s': %d/%d", F.col("pipeline"), running, F.lit(limit)
    )
    return submissions.join(running_counts(runs), "pipeline", "left").select(
        *[c for c in submissions.columns],
        running.alias("running"),
        (running < limit).alias("admitted"),
        F.when(running >= limit, refused).alias("reason"),
    )


def validate(
    submissions: DataFrame,
    pipelines: DataFrame,
    datasets: DataFrame,
    contracts: DataFrame,
    runs: DataFrame,
    limit: int = model.MAX_CONCURRENT_RUNS,
) -> DataFrame:
    """First broken rule of every submission, and the contract version it would use.

    Submissions have pipeline, run_id, dataset, contract_version, seq and the
    resolver's source_error and target_error. A run that is stored already is
    neither rejected nor evaluated again.
    """
    known = pipelines.select(F.col("name").alias("pipeline")).distinct().withColumn("known", F.lit(True))
    listed = (
        datasets.select("pipeline", F.col("name").alias("dataset")).distinct().withColumn("listed", F.lit(True))
    )
    newest = latest_contracts(contracts).select(
        "pipeline", "dataset", F.col("version").alias("newest_version")
    )
    asked = (
        contracts.select("pipeline", "dataset", F.col("version").alias("contract_version"))
        .distinct()
        .withColumn("asked", F.lit(True))
    )
    stored = runs.select(*model.RUN_KEY).distinct().withColumn("stored", F.lit(True))
    joined = (
        submissions.join(known, "pipeline", "left")
        .join(stored, model.RUN_KEY, "left")
        .join(listed, ["pipeline", "dataset"], "left")
        .join(newest, ["pipeline", "dataset"], "left")
        .join(asked, ["pipeline", "dataset", "contract_version"], "left")
        .join(running_counts(runs), "pipeline", "left")
    )
    version = F.col("contract_version")
    running = F.coalesce("running", F.lit(0).cast("bigint"))
    name, dataset = F.col("pipeline"), F.col("dataset")
    reason = (
        F.when(F.col("source_error").isNotNull(), F.concat(F.lit("Cannot resolve source: "), "source_error"))
        .when(F.col("target_error").isNotNull(), F.concat(F.lit("Cannot resolve target: "), "target_error"))
        .when(
            F.col("known").isNull(),
            F.format_string("Pipeline '%s' not registered. Register it first.", name),
        )
        .when(F.col("stored"), F.lit(None).cast("string"))
        .when(
            F.col("listed").isNull(),
            F.format_string("Dataset '%s' not found in pipeline '%s'.", dataset, name),
        )
        .when(
            version.isNotNull() & F.col("asked").isNull(),
            F.format_string("Contract version %d not found for dataset '%s'.", version, dataset),
        )
        .when(
            version.isNull() & F.col("newest_version").isNull(),
            F.format_string("No contract found for dataset '%s'.", dataset),
        )
        .when(
            running >= limit,
            F.format_string(
                "Concurrent run limit exceeded for '%s': %d/%d",
                name,
                running,
                F.lit(limit),
            ),
        )
    )
    unresolved = F.coalesce("source_error", "target_error")
    category = (
        F.when(F.lower(unresolved).contains("not found"), "source_not_found")
        .when(unresolved.isNotNull(), "source_not_readable")
        .when(F.col("known").isNotNull() & F.col("stored"), "duplicate_run")
        .when(reason.startswith("Concurrent run limit"), "concurrent_limit_exceeded")
        .when(reason.isNotNull(), "unknown")
    )
    return joined.select(
        "pipeline",
        "run_id",
        "dataset",
        F.coalesce("stored", F.lit(False)).alias("stored"),
        F.coalesce("contract_version", "newest_version").alias("effective_version"),
        reason.alias("reject_reason"),
        category.alias("error_category"),
    )
