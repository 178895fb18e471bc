"""Operational metrics over a moving day.

Every control table is read once. Counts per status of the fixed vocabularies
are conditional sums, so the only shuffles carry one row per task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import model
from pactline.functions.timestamps import iso_utc, micros_between, micros_of, moment_literal


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _day(column: str, as_of: datetime) -> Column:
    return F.col(column) >= moment_literal(as_of - timedelta(days=1))


def pipeline_counts(pipelines: DataFrame) -> DataFrame:
    return pipelines.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("enabled")).alias("active")
    )


def run_status_counts(runs: DataFrame, as_of: datetime) -> DataFrame:
    recent = runs.where(_day("started_at", as_of))
    return recent.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def average_duration(in_scope: Column) -> Column:
    """Mean duration in whole milliseconds of the ended runs in scope, 0 without any."""
    micros = micros_between(F.col("ended_at"), F.col("started_at"))
    counted = F.when(in_scope & F.col("ended_at").isNotNull(), micros)
    # Exact sums, so that the result does not depend on the order of the rows.
    total = F.sum(counted.cast("decimal(20,0)"))
    divisor = F.nullif(F.count(counted) * 1000, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(((total - total % divisor) / divisor).cast("bigint"), _zero())


def is_stuck(as_of: datetime) -> Column:
    hour_ago = moment_literal(as_of - timedelta(hours=1))
    return F.col("ended_at").isNull() & (F.col("started_at") < hour_ago)


def run_metrics(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Total, per status, mean duration and stuck runs in one pass."""
    recent = _day("started_at", as_of)
    per_status = [
        F.count_if(recent & (F.col("status") == s)).alias(s) for s in model.RUN_STATUSES
    ]
    entries = [x for s in model.RUN_STATUSES for x in (F.lit(s), F.col(s))]
    return runs.agg(
        F.count_if(recent).alias("total"),
        *per_status,
        average_duration(recent).alias("avg_duration_ms"),
        F.count_if(is_stuck(as_of)).alias("stuck"),
    ).select(
        "total",
        F.map_filter(F.create_map(*entries), lambda _, n: n > 0).alias("by_status"),
        "avg_duration_ms",
        "stuck",
    )


def failed_check_counts(checks: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """Failed checks of the day's runs by type.

    Failures are counted per run before the join, so a run with very many
    results joins as a handful of rows.
    """
    recent = runs.where(_day("started_at", as_of)).select(*model.RUN_KEY)
    per_run = (
        checks.where(F.col("status") == model.FAILED)
        .groupBy(*model.RUN_KEY, "check_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    joined = per_run.join(recent, model.RUN_KEY)
    return joined.groupBy("check_type").agg(F.sum("n").alias("failed"))


def open_incident_count(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count_if(F.col("status") == model.OPEN).alias("open"))


def notification_counts(notifications: DataFrame, as_of: datetime) -> DataFrame:
    recent = notifications.where(_day("created_at", as_of))
    return recent.groupBy("status").agg(F.count(F.lit(1)).alias("notifications"))


def _as_map(counts: DataFrame, key: str, value: str, total: str, name: str) -> DataFrame:
    """One row with the counts as a map and their sum; one entry per group."""
    pairs = F.array_sort(F.collect_list(F.struct(key, value)))
    return counts.agg(
        F.coalesce(F.sum(value), _zero()).alias(total), F.map_from_entries(pairs).alias(name)
    )


def operational_metrics(
    pipelines: DataFrame,
    runs: DataFrame,
    checks: DataFrame,
    incidents: DataFrame,
    notifications: DataFrame,
    as_of: datetime,
) -> DataFrame:
    """All metrics as one nested row."""
    failed = _as_map(
        failed_check_counts(checks, runs, as_of), "check_type", "failed", "total_failed", "failed_by_type"
    )
    sent = _as_map(notification_counts(notifications, as_of), "status", "notifications", "total", "by_status")

    def one(frame: DataFrame, *fields: str) -> Column:
        return frame.select(F.struct(*(fields or frame.columns))).scalar()

    stamp = iso_utc(F.lit(micros_of(as_of)).cast("bigint"))
    return pipelines.sparkSession.range(1).select(
        F.regexp_replace(stamp, r"\+00:00$", "").alias("timestamp"),
        one(pipeline_counts(pipelines)).alias("pipelines"),
        one(run_metrics(runs, as_of)).alias("runs_24h"),
        one(failed, "failed_by_type", "total_failed").alias("checks_24h"),
        one(open_incident_count(incidents)).alias("incidents"),
        one(sent).alias("notifications_24h"),
    )
