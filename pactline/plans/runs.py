"""From check results to run status, failure reason, incidents and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import model
from pactline.plans.registry import newest_rows


def _failed() -> Column:
    return F.col("status") == model.FAILED


def _of(check_type: str) -> Column:
    return F.col("check_type") == check_type


def stop_at_unreadable(checks: DataFrame, keys: Sequence[str] = model.RUN_KEY) -> DataFrame:
    """Drop what follows a failed readability check of the same run."""
    keys = list(keys)
    first = _of(model.SOURCE_READABILITY)
    stopped = checks.where(first & _failed()).select(*keys).distinct()
    later = checks.where(~first).join(stopped, keys, "left_anti")
    return checks.where(first).unionByName(later)


def _of_other_type() -> Column:
    return ~F.coalesce(F.col("check_type").isin(*model.CHECK_ORDER), F.lit(False))


def _per_check(checks: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """One row for each type of check of a run, with failed 0 or 1: repeats count once."""
    failed = F.max(F.when(_failed(), 1).otherwise(0)).alias("failed")
    return checks.groupBy(*keys, "check_type").agg(failed, *more)


def _totals() -> list[Column]:
    late = F.max(F.when(_of(model.FRESHNESS), F.col("failed")).otherwise(0))
    return [F.coalesce(F.sum("failed"), F.lit(0)).alias("failures"), late.alias("late")]


def _status() -> Column:
    return (
        F.when(F.col("failures") == 0, model.PASSED)
        .when((F.col("failures") == 1) & (F.col("late") == 1), model.LATE)
        .otherwise(model.FAILED)
    )


def run_verdicts(checks: DataFrame, keys: Sequence[str] = model.RUN_KEY) -> DataFrame:
    """Status of every run: passed, late when only freshness failed, else failed.

    Skipped checks do not count as failures. Every type of check counts, once
    however often its result was written.
    """
    return _per_check(checks, keys).groupBy(*keys).agg(*_totals()).select(
        *keys, F.col("failures").alias("failed_checks"), _status().alias("status")
    )


def finalize_runs(checks: DataFrame, keys: Sequence[str] = model.RUN_KEY) -> DataFrame:
    """Status, failure reason, row counts and first error category of every run.

    Results are folded per type of check first, so one that was written twice by a
    retry counts once. Texts are looked at for failures only.
    """
    keys = list(keys)
    slots = range(len(model.CHECK_ORDER))

    def counted(side: str) -> Column:
        value = F.get_json_object("observed", f"$.{side}").try_cast("bigint")
        return F.max(F.when(_of(model.ROW_COUNT), value)).alias(side)

    counted_sides = ("source_row_count", "target_row_count")
    per_check = _per_check(checks, keys, *[counted(side) for side in counted_sides])
    totals = per_check.groupBy(*keys).agg(*_totals(), *[F.max(side).alias(side) for side in counted_sides])
    texts = []
    for i, check_type in enumerate(model.CHECK_ORDER):
        message = F.coalesce("message", F.lit(f"{check_type} failed"))
        texts.append(F.min(F.when(_of(check_type), message)).alias(f"reason_{i}"))
        texts.append(F.min(F.when(_of(check_type), F.col("error_category"))).alias(f"category_{i}"))
    named = F.coalesce("message", F.concat(F.coalesce("check_type", F.lit("check")), F.lit(" failed")))
    others = (
        checks.where(_failed() & _of_other_type())
        .groupBy(*keys, "check_type")
        .agg(F.min("check_order").alias("check_order"), F.min(named).alias("reason"), F.min("error_category").alias("category"))
        .groupBy(*keys)
        .agg(
            F.expr("listagg(reason, '; ') WITHIN GROUP (ORDER BY check_order, check_type)").alias("other_reasons"),
            F.min("category").alias("other_category"),
        )
    )
    failures = (
        checks.where(_failed())
        .groupBy(*keys)
        .agg(*texts)
        .select(
            *keys,
            F.concat_ws("; ", *[f"reason_{i}" for i in slots]).alias("failure_reason"),
            F.coalesce(*[f"category_{i}" for i in slots]).alias("error_category"),
        )
    )
    reasons = F.concat_ws("; ", F.nullif("failure_reason", F.lit("")), "other_reasons")
    return totals.join(failures, keys, "left").join(others, keys, "left").select(
        *keys,
        _status().alias("status"),
        F.when(F.coalesce("failure_reason", "other_reasons").isNotNull(), reasons).alias("failure_reason"),
        "source_row_count",
        "target_row_count",
        F.coalesce("error_category", "other_category").alias("error_category"),
    )


def derive_incidents(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One open incident for every failed or late run, owned by the run's owner."""
    status = F.col("status")

    def rule(index: int) -> Column:
        chosen = F.lit(None).cast("string")
        for state, values in model.INCIDENT_RULES.items():
            chosen = F.when(status == state, values[index]).otherwise(chosen)
        return chosen

    owners = pipelines.select(F.col("name").alias("pipeline"), "owner")
    return (
        runs.where(status.isin(*model.INCIDENT_RULES))
        .join(owners, "pipeline")
        .select(
            "pipeline",
            "run_id",
            rule(0).alias("incident_type"),
            rule(1).alias("severity"),
            "owner",
            F.lit(model.OPEN).alias("status"),
            F.lit(True).alias("retryable"),
            F.col("failure_reason").alias("failure_summary"),
            F.col("ended_at").alias("first_observed_at"),
        )
    )


CHECK_ITEM = ["check_order", "check_type", "status", "expected", "observed", "message"]
INCIDENT_ITEM = ["incident_type", "severity", "owner", "status", "retryable", "failure_summary"]


def health_summary(runs: DataFrame, checks: DataFrame, incidents: DataFrame) -> DataFrame:
    """Runs with their checks, in check order, and their incidents as nested lists.

    The lists are sets of a run's own results, of any type: as long as the run
    has checks, with repeats of a retried write counted once. Sets are built by
    hashing, so the texts are not sorted on the way.
    """
    keys = list(model.RUN_KEY)

    def listed(items: Sequence[str]) -> Column:
        return F.array_sort(F.collect_set(F.struct(*items)))

    per_run_checks = checks.groupBy(*keys).agg(listed(CHECK_ITEM).alias("checks"))
    per_run_incidents = incidents.groupBy(*keys).agg(listed(INCIDENT_ITEM).alias("incidents"))
    no_checks = F.array().cast(per_run_checks.schema["checks"].dataType)
    no_incidents = F.array().cast(per_run_incidents.schema["incidents"].dataType)
    return (
        runs.join(per_run_checks, keys, "left")
        .join(per_run_incidents, keys, "left")
        .select(
            *keys,
            "status",
            "started_at",
            "ended_at",
            "source_row_count",
            "target_row_count",
            "failure_reason",
            "contract_version",
            F.coalesce("checks", no_checks).alias("checks"),
            F.coalesce("incidents", no_incidents).alias("incidents"),
        )
    )


def current_runs(events: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Latest event of every run; more columns that follow from the run may be part of the key."""
    return newest_rows(events, [*more, *model.RUN_KEY], ["event_no", "ended_at"])


def current_incidents(events: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Latest event of every incident; more columns that follow from the run may be part of the key."""
    return newest_rows(events, [*more, *model.RUN_KEY, "incident_type"], ["event_no", "first_observed_at"])
