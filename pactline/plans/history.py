"""Questions about past runs, incidents and notifications."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactline import model
from pactline.functions.timestamps import micros_between
from pactline.plans.registry import newest_rows
from pactline.plans.runs import health_summary

NEWEST = ["started_at", "seq"]


def latest_runs(runs: DataFrame, by: str = "started_at") -> DataFrame:
    """The latest run of every pipeline, by start time or by registration order.

    Maxima are taken before the shuffle: one row per pipeline and task is sent,
    not the runs, and a busy pipeline is no hot spot.
    """
    order = ["seq", "run_id"] if by == "seq" else [*NEWEST, "run_id"]
    return newest_rows(runs, ["pipeline"], order)


def _newest_first(names: Sequence[str]) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def duration_ms() -> Column:
    """Whole milliseconds from start to end, null while either is missing."""
    return F.floor(micros_between(F.col("ended_at"), F.col("started_at")) / 1000).cast("bigint")


RUN_ITEM = [
    "pipeline",
    "run_id",
    "status",
    "started_at",
    "ended_at",
    "duration_ms",
    "source_row_count",
    "target_row_count",
    "failure_reason",
    "contract_version",
]


def list_runs(
    runs: DataFrame,
    pipeline: str | None = None,
    status: str | None = None,
    limit: int = model.DEFAULT_PAGE_SIZE,
    offset: int = 0,
) -> DataFrame:
    """A page of runs, newest first: of one pipeline, or the same page of every pipeline."""
    if status and status not in model.RUN_STATUSES:
        raise ValueError(f"'{status}' is not a run status")
    found = runs.where(F.col("status") == status) if status else runs
    if pipeline is not None and offset + limit > SHALLOW:
        page = _deep_page(found.where(F.col("pipeline") == pipeline), NEWEST, offset, limit).orderBy(*_newest_first(NEWEST))
    elif pipeline is not None:
        page = (
            found.where(F.col("pipeline") == pipeline)
            .orderBy(*_newest_first(NEWEST))
            .offset(offset)
            .limit(limit)
        )
    else:
        page = _page_per_pipeline(found, NEWEST, offset, limit)
    return page.withColumn("duration_ms", duration_ms()).select(*RUN_ITEM)


#: Places up to which Spark keeps that many rows of each pipeline in every task before it shuffles.
SHALLOW = 1000


def _page_per_pipeline(rows: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows number offset + 1 to offset + limit of every pipeline."""
    if offset + limit > SHALLOW:
        return _deep_page(rows, order, offset, limit)
    # The bound on the rank lets Spark keep only that many rows per pipeline in
    # each task before the shuffle.
    window = Window.partitionBy("pipeline").orderBy(*_newest_first(order))
    ranked = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= offset + limit)
    return ranked.where(F.col("rank") > offset).drop("rank")


def _deep_page(rows: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """The page in two passes, the first of which finds the hours that it lies in.

    Rows are counted per pipeline and hour, with partial counts before the shuffle, and the
    counts of later hours added up. Only rows of hours that the page touches are then
    ranked, each hour by itself, so a pipeline that owns most rows is never in one task.
    """
    hours = {"__day": F.col(order[0]).cast("date"), "__hour": F.hour(order[0])}
    placed = rows.withColumns(hours)
    later = Window.partitionBy("pipeline").orderBy(*_newest_first(hours)).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("pipeline", *hours).agg(F.count(F.lit(1)).alias("__rows"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(later), F.lit(0)))
    touched = counts.where((F.col("__before") < offset + limit) & (F.col("__before") + F.col("__rows") > offset))
    touched = touched.select(*[F.col(c).alias(f"{c}_") for c in ("pipeline", *hours)], "__before")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("pipeline", *hours)])
    inside = Window.partitionBy("pipeline", *hours).orderBy(*_newest_first(order))
    rank = F.col("__before") + F.row_number().over(inside)
    ranked = placed.join(touched, same).withColumn("__rank", rank)
    return ranked.where((F.col("__rank") > offset) & (F.col("__rank") <= offset + limit)).select(*rows.columns)


def find_run(runs: DataFrame, run_id: str, pipeline: str | None = None) -> DataFrame:
    """A run of a pipeline, or the first registered one with that id."""
    found = runs.where(F.col("run_id") == run_id)
    if pipeline is not None:
        return found.where(F.col("pipeline") == pipeline)
    return found.orderBy("seq", "pipeline").limit(1)


def first_runs(runs: DataFrame) -> DataFrame:
    """For every run id, the pipeline that registered it first."""
    first = F.min(F.struct("seq", "pipeline")).alias("first")
    return runs.groupBy("run_id").agg(first).select("run_id", "first.pipeline", "first.seq")


def run_health(
    runs: DataFrame, checks: DataFrame, incidents: DataFrame, pipeline: str, run_id: str
) -> DataFrame:
    this = (F.col("pipeline") == pipeline) & (F.col("run_id") == run_id)
    return health_summary(runs.where(this), checks.where(this), incidents.where(this))


def latest_health(
    runs: DataFrame, checks: DataFrame, incidents: DataFrame, pipeline: str | None = None
) -> DataFrame:
    """Health of the latest run of one pipeline, or of each."""
    if pipeline is not None:
        runs = runs.where(F.col("pipeline") == pipeline)
    latest = latest_runs(runs)
    keys = latest.select(*model.RUN_KEY)
    return health_summary(
        latest,
        checks.join(keys, model.RUN_KEY, "left_semi"),
        incidents.join(keys, model.RUN_KEY, "left_semi"),
    )


def of_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Checks or incidents that belong to the given runs."""
    return rows.join(runs.select(*model.RUN_KEY), model.RUN_KEY, "left_semi")


def open_incidents(
    incidents: DataFrame,
    runs: DataFrame,
    pipeline: str | None = None,
    limit: int = model.DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """The newest open incidents of one pipeline, or of every pipeline."""
    found = incidents.where(F.col("status") == model.OPEN)
    order = ["first_observed_at", "run_id"]
    if pipeline is not None:
        found = of_runs(found.where(F.col("pipeline") == pipeline), runs)
        if limit > SHALLOW:
            return _deep_page(found, order, 0, limit).orderBy(*_newest_first(order))
        return found.orderBy(*_newest_first(order)).limit(limit)
    return _page_per_pipeline(of_runs(found, runs), order, 0, limit)


def acknowledge(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """Incidents after acknowledging those of the given runs; only open ones change."""
    marked = runs.select(*model.RUN_KEY).distinct().withColumn("marked", F.lit(True))
    change = F.col("marked") & (F.col("status") == model.OPEN)
    return (
        incidents.join(marked, model.RUN_KEY, "left")
        .withColumn("status", F.when(change, model.ACKNOWLEDGED).otherwise(F.col("status")))
        .select(*incidents.columns)
    )


def acknowledged_counts(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """How many incidents of each given run an acknowledgement would change."""
    changed = (
        incidents.where(F.col("status") == model.OPEN)
        .groupBy(*model.RUN_KEY)
        .agg(F.count(F.lit(1)).alias("acknowledged"))
    )
    return (
        runs.select(*model.RUN_KEY)
        .join(changed, model.RUN_KEY, "left")
        .select(*model.RUN_KEY, F.coalesce("acknowledged", F.lit(0).cast("bigint")).alias("acknowledged"))
    )


def notification_log(notifications: DataFrame, limit: int = model.DEFAULT_PAGE_SIZE) -> DataFrame:
    return notifications.orderBy(*_newest_first(["created_at", "seq"])).limit(limit)
