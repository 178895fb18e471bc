"""The seven health panels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import model
from pactline.functions.timestamps import HOUR_MICROS, micros_between, moment_literal
from pactline.plans.history import latest_runs


def named(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Runs of registered pipelines."""
    return runs.join(pipelines.select(F.col("name").alias("pipeline")), "pipeline")


def duration_seconds() -> Column:
    """Whole seconds, rounded half away from zero."""
    micros = micros_between(F.col("ended_at"), F.col("started_at"))
    return F.round(micros / 1_000_000).cast("bigint")


def latest_status(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    return (
        named(latest_runs(runs, by="seq"), pipelines)
        .select(
            "pipeline",
            "run_id",
            "status",
            "started_at",
            "ended_at",
            duration_seconds().alias("duration_seconds"),
            "source_row_count",
            "target_row_count",
            "failure_reason",
        )
        .orderBy("pipeline")
    )


def run_history(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    code = F.when(F.col("status") == model.PASSED, 0).when(F.col("status") == model.LATE, 1).otherwise(2)
    return (
        named(runs.where(F.col("ended_at").isNotNull()), pipelines)
        .select(F.col("started_at").alias("time"), "pipeline", code.alias("status_code"), "status")
        .orderBy("time")
    )


def hours_since_end(runs: DataFrame, pipelines: DataFrame, as_of: datetime) -> DataFrame:
    age = micros_between(moment_literal(as_of), F.col("ended_at")) / float(HOUR_MICROS)
    return (
        named(latest_runs(runs, by="seq"), pipelines)
        .select("pipeline", age.alias("age_hours"))
        .orderBy(F.col("age_hours").desc_nulls_first())
    )


def row_counts(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    return (
        named(latest_runs(runs, by="seq"), pipelines)
        .select(
            "pipeline",
            F.col("source_row_count").alias("source"),
            F.col("target_row_count").alias("target"),
        )
        .orderBy("pipeline")
    )


def failed_checks(checks: DataFrame) -> DataFrame:
    return (
        checks.where(F.col("status") == model.FAILED)
        .groupBy(F.col("check_type").alias("metric"))
        .agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.desc("value"))
    )


def all_open_incidents(incidents: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    known = named(runs.select(*model.RUN_KEY), pipelines)
    return (
        incidents.where(F.col("status") == model.OPEN)
        .join(known, model.RUN_KEY)
        .select(
            "pipeline",
            "run_id",
            "incident_type",
            "severity",
            "owner",
            "retryable",
            "failure_summary",
            "first_observed_at",
        )
        .orderBy(F.col("first_observed_at").desc_nulls_first())
    )


def schema_failures(checks: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Failed schema checks, of source or target, with their run's start."""
    failed = checks.where(
        F.col("check_type").isin(*model.SCHEMA_CHECKS) & (F.col("status") == model.FAILED)
    )
    known = named(runs.select(*model.RUN_KEY, "started_at", "seq"), pipelines)
    return failed.join(known, model.RUN_KEY).select(
        "pipeline", "run_id", "check_type", "message", "expected", "observed", "started_at", "seq"
    )


def recent_schema_drift(
    checks: DataFrame,
    runs: DataFrame,
    pipelines: DataFrame,
    rows: int = model.SCHEMA_DRIFT_PANEL_ROWS,
) -> DataFrame:
    order = [F.col("started_at").desc_nulls_first(), F.desc("seq"), F.asc("check_type")]
    return schema_failures(checks, runs, pipelines).orderBy(*order).limit(rows).drop("seq")
