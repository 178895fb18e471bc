"""Alert rules over the control tables, and alert records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline import model
from pactline.functions.text import KEEP_NULLS
from pactline.functions.timestamps import iso_utc, native_micros
from pactline.plans.dashboards import named, schema_failures
from pactline.plans.history import latest_runs

# Rule id, title, severity, owner and category of each alert.
RULES = {
    "failed_run": ("alert-pipeline-failed", "Pipeline run failed", "high", "data-platform", "pipeline-health"),
    "stale_data": ("alert-freshness-exceeded", "Freshness age exceeds threshold", "high", "data-platform", "freshness"),
    "open_incidents": ("alert-open-incidents", "Open incidents detected", "medium", "data-platform", "incidents"),
    "schema_drift": ("alert-schema-drift", "Schema drift detected", "high", "data-platform", "schema-drift"),
}


def failed_runs(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Pipelines whose latest run failed."""
    failed = latest_runs(runs, by="seq").where(F.col("status") == model.FAILED)
    return (
        named(failed, pipelines)
        .select("pipeline", "run_id", "status", "failure_reason", F.col("ended_at").alias("time"))
        .orderBy(F.col("time").desc_nulls_first())
    )


def stale_data(checks: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Latest runs whose freshness check reports an age above its limit."""
    age = F.get_json_object("observed", "$.age_hours").try_cast("double")
    limit = F.get_json_object("expected", "$.max_age_hours").try_cast("double")
    failed = checks.where(
        (F.col("check_type") == model.FRESHNESS) & (F.col("status") == model.FAILED) & (age > limit)
    ).select(*model.RUN_KEY, age.alias("age_hours"), limit.alias("threshold_hours"))
    latest = named(latest_runs(runs, by="seq"), pipelines)
    return failed.join(latest, model.RUN_KEY).select(
        "pipeline", "age_hours", "threshold_hours", F.col("started_at").alias("time")
    )


def incidents_open(incidents: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    known = named(runs.select(*model.RUN_KEY), pipelines)
    return (
        incidents.where(F.col("status") == model.OPEN)
        .join(known, model.RUN_KEY)
        .select("pipeline", "severity", "owner", "failure_summary", F.col("first_observed_at").alias("time"))
        .orderBy(F.col("time").desc_nulls_first())
    )


def schema_drift(checks: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Failed schema checks of the latest runs."""
    return (
        schema_failures(checks, latest_runs(runs, by="seq"), pipelines)
        .select(
            "pipeline", "check_type", "message", "expected", "observed", F.col("started_at").alias("time")
        )
        .orderBy(F.col("time").desc_nulls_first())
    )


def rule_rows(
    pipelines: DataFrame, runs: DataFrame, checks: DataFrame, incidents: DataFrame
) -> dict[str, DataFrame]:
    return {
        "failed_run": failed_runs(runs, pipelines),
        "stale_data": stale_data(checks, runs, pipelines),
        "open_incidents": incidents_open(incidents, runs, pipelines),
        "schema_drift": schema_drift(checks, runs, pipelines),
    }


def evaluate(found: Mapping[str, DataFrame]) -> DataFrame:
    """One row per rule: how many rows it found and whether it fires."""
    result = None
    for name, frame in found.items():
        uid, title, severity, owner, category = RULES[name]
        row = frame.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(uid).alias("rule"),
            F.lit(title).alias("title"),
            F.lit(severity).alias("severity"),
            F.lit(owner).alias("owner"),
            F.lit(category).alias("category"),
            "value",
            (F.col("value") > 0).alias("firing"),
        )
        result = row if result is None else result.unionByName(row)
    return result


# -- all rules in one fold -------------------------------------------------


def _part(rows: DataFrame, **given: Column) -> DataFrame:
    """Rows of one log in the shape that all of them share; what a log does not say is null."""
    kinds = {
        "run": "struct<event_no: int, ended_at: timestamp_ntz, seq: bigint, status: string>",
        "attempt": "int",
        "late": "struct<attempt: int, expected: string, observed: string>",
        "source_drift": "int",
        "target_drift": "int",
        "incident": "struct<incident_type: string, event_no: int, first_observed_at: timestamp_ntz, status: string>",
    }
    none = F.lit(None)
    return rows.select(*model.RUN_KEY, *[given.get(n, none).cast(kind).alias(n) for n, kind in kinds.items()])


def _event_no(rows: DataFrame) -> Column:
    """Settled tables need no event number."""
    return F.col("event_no") if "event_no" in rows.columns else F.lit(0)


def tagged(runs: DataFrame, checks: DataFrame, incidents: DataFrame) -> DataFrame:
    """What the rules need of the three logs, or of the settled tables, one under the other."""
    kind, attempt = F.col("check_type"), F.coalesce("attempt", F.lit(1)) if "attempt" in checks.columns else F.lit(1)
    failed = (F.col("status") == model.FAILED) & kind.isin(model.FRESHNESS, *model.SCHEMA_CHECKS)
    # Of resumed runs all results say which attempt is the last.
    told = checks.where(failed | (attempt > 1))
    first, second = (F.when(failed & (kind == t), attempt) for t in model.SCHEMA_CHECKS)
    event = F.struct(_event_no(runs), "ended_at", "seq", "status")
    change = F.struct("incident_type", _event_no(incidents), "first_observed_at", "status")
    late = F.when(failed & (kind == model.FRESHNESS), F.struct(attempt, "expected", "observed"))
    return (
        _part(runs, run=event)
        .unionByName(_part(told, attempt=attempt, late=late, source_drift=first, target_drift=second))
        .unionByName(_part(incidents, incident=change))
    )


def per_run(rows: DataFrame) -> DataFrame:
    """Tagged rows folded by run: its newest event, the last attempts that failed, the changes of its few incidents.

    Folding events again, or in another order, gives the same.
    """
    return rows.groupBy(*model.RUN_KEY).agg(
        F.max("run").alias("run"),
        F.max("attempt").alias("attempt"),
        F.max("late").alias("late"),
        F.max("source_drift").alias("source_drift"),
        F.max("target_drift").alias("target_drift"),
        F.collect_set("incident").alias("incidents"),
    )


LIVE = "pipeline string, run_id string, seq bigint, failed int, stale int, drift int, open int"


def contributions(folded: DataFrame) -> DataFrame:
    """What each known run adds to the rules: (LIVE). Only a pipeline's latest run counts but for open incidents."""
    age = F.get_json_object("late.observed", "$.age_hours").try_cast("double")
    limit = F.get_json_object("late.expected", "$.max_age_hours").try_cast("double")
    order = lambda e: F.struct(e["event_no"], e["first_observed_at"])
    replaced = lambda e: F.exists("incidents", lambda o: (o["incident_type"] == e["incident_type"]) & (order(o) > order(e)))
    still_open = F.filter("incidents", lambda e: (e["status"] == model.OPEN) & ~replaced(e))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return folded.where("run IS NOT NULL").select(
        *model.RUN_KEY,
        F.col("run.seq").alias("seq"),
        flag(F.col("run.status") == model.FAILED).alias("failed"),
        flag((F.col("late.attempt") == F.col("attempt")) & (age > limit)).alias("stale"),
        (flag(F.col("source_drift") == F.col("attempt")) + flag(F.col("target_drift") == F.col("attempt"))).alias("drift"),
        F.size(still_open).alias("open"),
    )


def rule_states(live: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One row per rule from the runs' contributions: how many rows it finds and whether it fires."""
    latest = F.max_by(F.struct("failed", "stale", "drift"), F.struct("seq", "run_id"))
    per_pipeline = named(live.groupBy("pipeline").agg(latest.alias("latest"), F.sum("open").alias("open")), pipelines)
    found = {"failed_run": "latest.failed", "stale_data": "latest.stale", "open_incidents": "open", "schema_drift": "latest.drift"}
    totals = per_pipeline.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in found.items()])
    rules = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(("rule", "title", "severity", "owner", "category"), RULES[name])], F.col(name).alias("value"))
        for name in found
    ]
    return totals.select(F.inline(F.array(*rules))).withColumn("firing", F.col("value") > 0)


def states(pipelines: DataFrame, runs: DataFrame, checks: DataFrame, incidents: DataFrame) -> DataFrame:
    """The state of every rule, with one scan of each table and one shuffle of what failed."""
    return rule_states(contributions(per_run(tagged(runs, checks, incidents))), pipelines)


def notification_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Alert name and status of received alert documents.

    Needs ``created_at`` and ``seq``; the whole document is kept.
    """
    text = F.col(payload)
    return payloads.select(
        F.get_json_object(text, "$.alerts[0].labels.alertname").alias("alert_name"),
        F.coalesce(F.get_json_object(text, "$.status"), F.lit("unknown")).alias("status"),
        text.alias("payload"),
        "created_at",
        "seq",
    )


# Where the links of an alert document point unless told otherwise.
RUN_LINK = "http://localhost:8000/pipelines/%s/runs/%s"
BOARD_LINK = "http://localhost:3000/d/health"


def alert_records(
    runs: DataFrame,
    checks: DataFrame,
    incidents: DataFrame,
    sent_at: Column,
    run_link: str = RUN_LINK,
    board_link: str = BOARD_LINK,
) -> DataFrame:
    """The alert document of every run that has an incident.

    Holds the failed checks in check order, the incident's owner and links.
    """
    keys = list(model.RUN_KEY)
    failed = F.col("status") == model.FAILED
    found = F.array_sort(F.collect_set(F.struct("check_order", F.col("check_type").alias("type"), "message")))
    failures = checks.where(failed).groupBy(*keys).agg(
        F.transform(found, lambda c: F.struct(c["type"].alias("type"), c["message"].alias("message"))).alias("failed_checks")
    )
    owned = incidents.groupBy(*keys).agg(F.min("owner").alias("owner"), F.max("retryable").alias("retryable"))
    document = F.struct(
        "pipeline",
        "run_id",
        "status",
        iso_utc(native_micros(sent_at, T.TimestampNTZType())).alias("timestamp"),
        F.coalesce("failed_checks", F.array().cast(failures.schema["failed_checks"].dataType)).alias(
            "failed_checks"
        ),
        F.struct("owner", "retryable").alias("incident"),
        F.struct(
            F.format_string(run_link, "pipeline", "run_id").alias("run"), F.lit(board_link).alias("grafana")
        ).alias("links"),
    )
    return (
        runs.join(owned, keys)
        .join(failures, keys, "left")
        .select(*keys, F.to_json(document, KEEP_NULLS).alias("payload"))
    )
