"""Snapshots of the control logs, and writers that share the folder."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pactline import model
from pactline.plans.history import run_health
from pactline.sources.store import SETTLED, ControlStore, hour_of, settled_checks

START = datetime(2026, 8, 1, 9, 30, tzinfo=timezone.utc)


class Clock:
    def __init__(self, now=START):
        self.now = now

    def __call__(self):
        return self.now

    def later(self, hours):
        self.now += timedelta(hours=hours)


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    return ControlStore(spark, str(tmp_path / "control"), clock)


def add(store, count, event_no, status, pipelines=("p", "q", "r"), first=0):
    """Events, checks and incidents of runs number first to first + count, dealt to the pipelines."""
    day = datetime(2026, 8, 1)
    keys = [(pipelines[i % len(pipelines)], f"run-{i}", i) for i in range(first, first + count)]
    runs = [(p, r, status, 10, None, None, 1, day, day, i, event_no) for p, r, i in keys]
    checks = [(p, r, n + 1, t, status, "{}", "{}", f"{t} {r}", None, 1) for p, r, _ in keys for n, t in enumerate(model.CHECK_ORDER)]
    incidents = [(p, r, "contract_violation", "medium", "ann", model.OPEN, True, "why", day, event_no) for p, r, _ in keys]
    store.append("runs", store.spark.createDataFrame(runs, model.RUNS))
    store.append("checks", store.spark.createDataFrame(checks, model.CHECKS), date(2026, 8, 1))
    store.append("incidents", store.spark.createDataFrame(incidents, model.INCIDENTS))


def contents(store):
    return [sorted(map(repr, f.collect())) for f in (store.runs(), store.checks(), store.incidents(), store.checks(date(2026, 8, 1)))]


def test_snapshots_and_younger_events_settle_like_the_logs(store, clock):
    whole = ControlStore(store.spark, store.root, clock)
    whole._snapshot = lambda: None
    add(store, 40, 1, "running")
    assert store.fold() is None or store._snapshot()[0] < hour_of(clock())
    clock.later(5)
    add(store, 10, 2, "passed", first=5)
    assert store.fold() == hour_of(clock() - timedelta(hours=3))
    assert contents(store) == contents(whole)
    # The second one takes the first and what came since; the last events stay younger.
    clock.later(6)
    add(store, 30, 2, "failed", first=20)
    clock.later(4)
    add(store, 30, 2, "late", first=50)
    store.fold(buckets=5)
    assert contents(store) == contents(whole) and store.runs().count() == 80
    assert store.fold() is None


def test_a_fold_that_dies_before_the_switch_changes_nothing(store, clock, monkeypatch):
    add(store, 12, 1, "running")
    clock.later(6)
    before = contents(store)

    def dies(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(store, "_publish", dies)
        store.fold()
    assert store._snapshot() is None and contents(store) == before
    add(store, 12, 2, "passed")
    store.fold()
    assert store._snapshot() is not None and store.runs().where("status = 'passed'").count() == 12


def test_a_write_that_takes_hours_is_written_again(store, clock, monkeypatch):
    """Its hour may be folded by the time it ends; the repeat is in an open hour."""
    rows = store.spark.createDataFrame([("p", "slow", "passed", 1, None, None, 1, START.replace(tzinfo=None), None, 1, 2)], model.RUNS)
    moments = iter([clock.now, clock.now + timedelta(hours=4), clock.now + timedelta(hours=4), clock.now + timedelta(hours=4)])
    monkeypatch.setattr(store, "clock", lambda: next(moments))
    store.append("runs", rows)
    monkeypatch.setattr(store, "clock", clock)
    assert store.log("runs").count() == 2 and store.runs().count() == 1


def test_health_of_one_run_reads_one_bucket_of_the_snapshot(store, clock):
    add(store, 60, 1, "failed", pipelines=tuple(f"p{i}" for i in range(20)))
    clock.later(6)
    store.fold()
    add(store, 1, 2, "passed", pipelines=("p0",))
    found = run_health(store.runs("p3"), store.checks(pipeline="p3"), store.incidents("p3"), "p3", "run-23")
    bucket = store.spark.range(1).select(F.pmod(F.xxhash64(F.lit("p3")), F.lit(64)).cast("int")).first()[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"(bucket") >= 3 and plan.count(f"= {bucket})") >= 3 and "EqualTo(pipeline,p3)" in plan
    # Events up to the snapshot's hour are not read from the logs.
    assert "hour" in plan and f"> {store._snapshot()[0]})" in plan
    row = found.first()
    assert row["status"] == "failed" and len(row["checks"]) == 5 and len(row["incidents"]) == 1
    young = run_health(store.runs("p0"), store.checks(pipeline="p0"), store.incidents("p0"), "p0", "run-0").first()
    assert young["status"] == "passed" and len(young["checks"]) == 5


def test_the_last_attempt_only(store):
    def checks(attempt, *results):
        rows = [("p", "a", model.CHECK_ORDER.index(t) + 1, t, s, None, None, None, None, attempt) for t, s in results]
        store.append("checks", store.spark.createDataFrame(rows, model.CHECKS), date(2026, 8, 1))

    checks(1, *((t, "failed") for t in model.CHECK_ORDER))
    checks(2, (model.SOURCE_READABILITY, "passed"), (model.ROW_COUNT, "failed"))
    checks(2, (model.ROW_COUNT, "failed"))
    assert {(r["check_type"], r["status"]) for r in store.checks().collect()} == {
        (model.SOURCE_READABILITY, "passed"), (model.ROW_COUNT, "failed")
    }
    assert store.checks().count() == 2


def test_a_fold_shuffles_each_log_once(spark):
    for table, settle in SETTLED.items():
        rows = spark.createDataFrame([], f"{model.CONTROL_TABLES[table]}, month date, bucket int")
        plan = settle(rows.repartitionByRange("bucket", *model.RUN_KEY), ["bucket"]).sortWithinPartitions("bucket", *model.RUN_KEY)
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_one_result_of_a_repeated_check(spark):
    rows = [("p", "a", n, t, s, None, None, m, None, 1) for n, t, s, m in (
        (2, "x", "failed", None), (1, "x", "failed", "b"), (1, "x", "failed", "a"), (1, "x", "failed", "a"), (None, "y", None, None), (3, None, "passed", "c"), (3, None, "passed", "c")
    )]
    found = settled_checks(spark.createDataFrame([*rows, (None, *rows[0][1:])], model.CHECKS)).collect()
    assert {(r["pipeline"], r["check_type"], r["check_order"], r["message"]) for r in found} == {
        ("p", "x", 1, "a"), ("p", "y", None, None), ("p", None, 3, "c"), (None, "x", 2, None)
    } and len(found) == 4
