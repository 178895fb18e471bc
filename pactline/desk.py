"""The entry points of the service, as calls that return DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline import model
from pactline.functions.timestamps import micros_of, moment_literal
from pactline.operators.checks import contract_checks
from pactline.plans import admission, alerts, history, metrics, registry
from pactline.plans.runs import derive_incidents, finalize_runs
from pactline.session import settle
from pactline.sources.claims import turn
from pactline.sources.contracts import Contract, contract_rows
from pactline.sources.resolve import OBJECT_STORE_PREFIX, READ_ERRORS, Resolved, resolve, root_cause
from pactline.sources.store import ControlStore

RUNS_PER_JOB = 32


@dataclass(frozen=True)
class Submission:
    pipeline: str
    run_id: str
    source: str
    dataset: str
    target: str | None = None
    target_dataset: str | None = None
    contract_version: int | None = None


class Rejected(ValueError):
    """A submission that breaks a rule; no run is recorded for it."""


class ContractDesk:
    """Registers contracts, evaluates runs against them and answers questions.

    ``on_unreadable`` says what an unreadable source does: ``reject`` the
    submission, or ``record`` a run that failed its first check.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        *,
        clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
        object_store: str = OBJECT_STORE_PREFIX,
        on_unreadable: str = "reject",
        rule_set: str = "reference",
    ):
        if on_unreadable not in ("reject", "record"):
            raise ValueError(f"on_unreadable must be reject or record, not {on_unreadable}")
        self.spark = spark
        self.store = ControlStore(spark, root)
        self.clock = clock
        self.object_store = object_store
        self.on_unreadable = on_unreadable
        self.rule_set = rule_set

    def _seq(self) -> int:
        return micros_of(self.clock())

    # -- registry ----------------------------------------------------------

    def register_pipeline(self, name: str, owner: str) -> DataFrame:
        """Get or create; an existing owner stays."""
        row = self.spark.createDataFrame([(name, owner, True, self._seq())], model.PIPELINES)
        fresh = registry.to_create(self.store.pipelines(), row, registry.PIPELINE_KEY)
        self.store.append("pipelines", fresh)
        return registry.pipeline_by_name(self.store.pipelines(), name)

    def register_dataset(
        self,
        pipeline: str,
        dataset: str,
        role: str,
        schema_definition: Mapping[str, Any],
        freshness: Mapping[str, Any],
        quality_rules: Mapping[str, Any],
        contract_version: int = 1,
        location: str | None = None,
    ) -> DataFrame:
        """Get or create the dataset and this version of its contract."""
        if registry.pipeline_by_name(self.store.pipelines(), pipeline).isEmpty():
            raise Rejected(f"Pipeline '{pipeline}' not found. Register it first.")
        seq = self._seq()
        row = self.spark.createDataFrame([(pipeline, dataset, role, location, seq)], model.DATASETS)
        self.store.append(
            "datasets", registry.to_create(self.store.datasets(), row, registry.DATASET_KEY)
        )
        entry = {
            "pipeline": pipeline,
            "dataset": dataset,
            "version": contract_version,
            "schema_definition": schema_definition,
            "freshness": freshness,
            "quality_rules": quality_rules,
        }
        rows = contract_rows(self.spark, [entry], seq)
        self.store.append(
            "contracts", registry.to_create(self.store.contracts(), rows, registry.CONTRACT_KEY)
        )
        return registry.contract_by_version(self.store.contracts(), pipeline, dataset, contract_version)

    def contract(self, dataset: str, pipeline: str | None = None) -> DataFrame:
        """Summary of the dataset's latest contract."""
        chosen = registry.dataset_by_name(self.store.datasets(), dataset, pipeline)
        return registry.contract_summaries(self.store.contracts(), chosen)

    # -- runs --------------------------------------------------------------

    def submit_run(self, submission: Submission) -> DataFrame:
        """Evaluate one run and return its health; a known run is returned as stored."""
        for _, reason in self.submit_runs([submission]):
            raise Rejected(reason)
        return self.run_health(submission.pipeline, submission.run_id)

    def submit_runs(
        self, submissions: Iterable[Submission], *, resume: bool = False
    ) -> list[tuple[Submission, str]]:
        """Evaluate many runs; returns the rejected ones with the reason.

        The list of submissions is planned on the driver, their datasets are
        checked in shared jobs. With ``resume`` runs that are stored as running are
        evaluated too, as a new attempt: for use after the driver that began them has
        died. Drivers decide one after the other, so a run is begun by one of them only
        and a pipeline's running runs stay within their limit.
        """
        firsts: dict[tuple[str, str], Submission] = {}
        for s in submissions:
            firsts.setdefault((s.pipeline, s.run_id), s)
        wanted = list(firsts.values())
        sources = [self._resolve(s.source) for s in wanted]
        targets = [self._resolve(s.target) if s.target else None for s in wanted]
        rejected, accepted = [], []
        if not wanted:
            return rejected
        with turn(self.store, [s.pipeline for s in wanted]) as check:
            decisions = self._decide(wanted, sources, targets)
            begun = self._begun(wanted) if resume else {}
            for s, source, target in zip(wanted, sources, targets):
                decision, key = decisions[(s.pipeline, s.run_id)], (s.pipeline, s.run_id)
                if decision["reject_reason"] is not None:
                    rejected.append((s, decision["reject_reason"]))
                elif not decision["stored"] or key in begun:
                    attempt = begun[key] // 2 + 2 if key in begun else 1
                    accepted.append((s, source, target, decision["effective_version"], attempt))
            start = self.clock()
            check()
            keys = self._begin(accepted, start)
        for i in range(0, len(accepted), RUNS_PER_JOB):
            part = accepted[i : i + RUNS_PER_JOB]
            self._conclude(part, keys, start, self._contracts_for(part))
        return rejected

    def _begun(self, wanted: list) -> dict:
        """Number of the last event of the wanted runs whose last event says that they are running.

        Every attempt has two events: it begins with an odd number and ends with an even one.
        """
        asked = self.spark.createDataFrame([(s.pipeline, s.run_id) for s in wanted], "pipeline string, run_id string")
        running = self.store.runs().where(F.col("status") == model.RUNNING).select(*model.RUN_KEY, "event_no")
        return {(r["pipeline"], r["run_id"]): r["event_no"] for r in running.join(asked, model.RUN_KEY, "left_semi").collect()}

    def _resolve(self, uri: str) -> Resolved:
        return resolve(self.spark, uri, object_store=self.object_store)

    def _decide(self, wanted: list, sources: list, targets: list) -> dict:
        shape = (
            "pipeline string, run_id string, dataset string, contract_version int, "
            "seq bigint, source_error string, target_error string"
        )
        recorded = self.on_unreadable == "record"
        rows = [
            (
                s.pipeline,
                s.run_id,
                s.dataset,
                s.contract_version,
                i,
                None if recorded else source.error,
                None if recorded or target is None else target.error,
            )
            for i, (s, source, target) in enumerate(zip(wanted, sources, targets))
        ]
        store = self.store
        decided = admission.validate(
            self.spark.createDataFrame(rows, shape),
            store.pipelines(),
            store.datasets(),
            store.contracts(),
            store.runs(),
        )
        # As many rows as the caller handed in.
        return {(r["pipeline"], r["run_id"]): r for r in decided.collect()}

    def _contracts_for(self, accepted: list) -> tuple[dict, dict]:
        """Source contracts by (pipeline, dataset, version), target contracts by (pipeline, dataset)."""
        shape = "pipeline string, dataset string, version int"
        asked = self.spark.createDataFrame(
            [(s.pipeline, s.dataset, version) for s, _, _, version, _ in accepted], shape
        ).distinct()
        found = self.store.contracts().join(asked, ["pipeline", "dataset", "version"], "left_semi")
        sources = {
            (r["pipeline"], r["dataset"], r["version"]): Contract.from_row(r) for r in found.collect()
        }
        pairs = [
            (s.pipeline, s.target_dataset)
            for s, _, target, _, _ in accepted
            if target is not None and s.target_dataset
        ]
        if not pairs:
            return sources, {}
        asked = self.spark.createDataFrame(pairs, "pipeline string, dataset string").distinct()
        newest = registry.latest_contracts(self.store.contracts()).join(
            asked, ["pipeline", "dataset"], "left_semi"
        )
        return sources, {(r["pipeline"], r["dataset"]): Contract.from_row(r) for r in newest.collect()}

    def _begin(self, accepted: list, start: datetime) -> DataFrame:
        """Record the runs as running; returns their keys, versions and attempts."""
        seq = micros_of(start)
        keys = self.spark.createDataFrame(
            [(s.pipeline, s.run_id, version, seq + i, attempt) for i, (s, _, _, version, attempt) in enumerate(accepted)],
            "pipeline string, run_id string, contract_version int, seq bigint, attempt int",
        )
        empty = {
            "source_row_count": F.lit(None).cast("bigint"),
            "target_row_count": F.lit(None).cast("bigint"),
            "failure_reason": F.lit(None).cast("string"),
            "ended_at": F.lit(None).cast("timestamp_ntz"),
        }
        if accepted:
            self.store.append(
                "runs",
                keys.select(
                    "*",
                    F.lit(model.RUNNING).alias("status"),
                    moment_literal(start).alias("started_at"),
                    (F.col("attempt") * 2 - 1).alias("event_no"),
                    *[v.alias(k) for k, v in empty.items()],
                ),
            )
        return keys

    def _conclude(self, accepted: list, keys: DataFrame, start: datetime, contracts: tuple[dict, dict]) -> None:
        """Check, and record how the runs ended; a dataset that cannot be scanned fails its own run only."""
        try:
            checks = self._checked(accepted, start, contracts)
        except READ_ERRORS as exc:
            if len(accepted) > 1:
                for one in accepted:
                    self._conclude([one], keys, start, contracts)
                return
            checks = self._checked_apart(accepted[0], start, contracts, exc)
        self.store.append("checks", checks.join(keys.select(*model.RUN_KEY, "attempt"), model.RUN_KEY), start.date())
        ended = moment_literal(self.clock())
        final = finalize_runs(checks).join(keys, model.RUN_KEY)
        event_no = (F.col("attempt") * 2).alias("event_no")
        rows = final.select("*", moment_literal(start).alias("started_at"), ended.alias("ended_at"), event_no)
        # The final event comes last: until it is there the run can be resumed, and
        # whatever was written before is read once only.
        incidents = derive_incidents(rows, self.store.pipelines()).withColumn("event_no", F.lit(0))
        if any(attempt > 1 for *_, attempt in accepted):
            incidents = incidents.unionByName(self._settled_incidents(accepted, incidents))
        self.store.append("incidents", incidents)
        self.store.append("runs", rows)

    def _settled_incidents(self, accepted: list, incidents: DataFrame) -> DataFrame:
        """Open incidents of earlier attempts that the last one did not confirm, now resolved."""
        resumed = self.spark.createDataFrame(
            [(s.pipeline, s.run_id) for s, *_, attempt in accepted if attempt > 1], "pipeline string, run_id string"
        )
        known = self.store.incidents().where(F.col("status") == model.OPEN).join(resumed, model.RUN_KEY, "left_semi")
        gone = known.join(incidents, [*model.RUN_KEY, "incident_type"], "left_anti")
        return gone.withColumn("status", F.lit(model.RESOLVED)).withColumn("event_no", F.col("event_no") + 1)

    def _checked_apart(self, one: tuple, start: datetime, contracts: tuple[dict, dict], exc: Exception) -> DataFrame:
        """Results of a run whose scan failed: of its target, if its source alone can be scanned."""
        s, source, target, version, attempt = one
        if target is not None and target.readable:
            try:
                lost = Resolved(target.uri, error=f"Failed to read: {root_cause(exc)}")
                return self._checked([(s, source, lost, version, attempt)], start, contracts)
            except READ_ERRORS as own:
                exc = own
        lost = Resolved(source.uri, error=f"Failed to read: {root_cause(exc)}")
        return self._checked([(s, lost, target, version, attempt)], start, contracts)

    def _checked(self, accepted: list, start: datetime, contracts: tuple[dict, dict]) -> DataFrame:
        source_contracts, target_contracts = contracts
        results = [
            contract_checks(
                source,
                source_contracts[(s.pipeline, s.dataset, version)],
                start,
                target,
                target_contracts.get((s.pipeline, s.target_dataset)),
                self.rule_set,
            ).select(F.lit(s.pipeline).alias("pipeline"), F.lit(s.run_id).alias("run_id"), "*")
            for s, source, target, version, _ in accepted
        ]
        # A handful of rows per run, computed once for the log and the verdict.
        return settle(reduce(DataFrame.unionByName, results))

    # -- questions ---------------------------------------------------------

    def run_health(self, pipeline: str, run_id: str) -> DataFrame:
        s = self.store
        return history.run_health(s.runs(pipeline), s.checks(pipeline=pipeline), s.incidents(pipeline), pipeline, run_id)

    def pipeline_health(self, pipeline: str) -> DataFrame:
        s = self.store
        return history.latest_health(s.runs(pipeline), s.checks(pipeline=pipeline), s.incidents(pipeline), pipeline)

    def list_runs(
        self, pipeline: str, status: str | None = None, limit: int = 20, offset: int = 0
    ) -> DataFrame:
        return history.list_runs(self.store.runs(pipeline), pipeline, status, limit, offset)

    def list_incidents(self, pipeline: str, limit: int = 20) -> DataFrame:
        return history.open_incidents(self.store.incidents(pipeline), self.store.runs(pipeline), pipeline, limit)

    def acknowledge(self, run_id: str) -> int:
        """Acknowledge the run's open incidents; returns how many there were."""
        run = history.find_run(self.store.runs(), run_id)
        if run.isEmpty():
            raise Rejected(f"Run '{run_id}' not found.")
        changed = history.of_runs(self.store.incidents(), run).where(F.col("status") == model.OPEN)
        # A run has at most one incident of each type.
        count = changed.count()
        if count:
            self.store.append(
                "incidents",
                changed.withColumn("status", F.lit(model.ACKNOWLEDGED)).withColumn(
                    "event_no", F.col("event_no") + 1
                ),
            )
        return count

    def receive_alert(self, payload: Mapping[str, Any] | str) -> None:
        """Keep a received alert document."""
        text = payload if isinstance(payload, str) else json.dumps(payload)
        now = self.clock()
        rows = self.spark.createDataFrame([(text, micros_of(now))], "payload string, seq bigint").withColumn(
            "created_at", moment_literal(now)
        )
        self.store.append("notifications", alerts.notification_rows(rows))

    def notification_log(self, limit: int = 20) -> DataFrame:
        return history.notification_log(self.store.notifications(), limit)

    def fold(self) -> int | None:
        """Write a snapshot of the logs' closed hours, which all questions read from then on."""
        return self.store.fold()

    def metrics(self) -> DataFrame:
        s, now = self.store, self.clock()
        # What only counts for the last day is read from its folders only.
        since = (now - timedelta(days=1)).date()
        return metrics.operational_metrics(
            s.pipelines(),
            s.runs(),
            s.checks(since),
            s.incidents(),
            s.notifications(since),
            now,
        )

    def alerts(self) -> DataFrame:
        s = self.store
        return alerts.states(s.pipelines(), s.runs(), s.checks(), s.incidents())
