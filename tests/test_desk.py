"""The service end to end on a fresh folder of control tables."""

import itertools
import json
from datetime import datetime, timedelta

import pytest

from conftest import TIDE_FRESHNESS, TIDE_QUALITY, TIDE_SCHEMA, tide_rows
from pactline import model
from pactline.desk import ContractDesk, Rejected, Submission

PIPELINE, DATASET = "harbour_gauges", "tide_readings"


def ticking(start=datetime(2026, 8, 1, 12)):
    steps = itertools.count()
    return lambda: start + timedelta(milliseconds=10 * next(steps))


@pytest.fixture
def desk(spark, tmp_path):
    desk = ContractDesk(spark, str(tmp_path / "control"), clock=ticking())
    desk.register_pipeline(PIPELINE, "data-platform")
    desk.register_dataset(
        PIPELINE, DATASET, "source", TIDE_SCHEMA, TIDE_FRESHNESS, TIDE_QUALITY
    )
    return desk


def run(run_id, source, **rest):
    return Submission(PIPELINE, run_id, source, DATASET, **rest)


def states(health):
    return {c["check_type"]: c["status"] for c in health["checks"]}


def test_registration_keeps_the_first_owner(desk):
    assert desk.register_pipeline(PIPELINE, "someone else").first()["owner"] == "data-platform"
    assert desk.store.pipelines().count() == 1


def test_contract_versions_are_immutable(desk):
    again = desk.register_dataset(PIPELINE, DATASET, "source", {"x": {}}, {}, {}, 1).first()
    assert set(json.loads(again["schema_definition"])) == set(TIDE_SCHEMA)
    with pytest.raises(Rejected, match="not found"):
        desk.register_dataset("absent", DATASET, "source", {}, {}, {})


def test_contract_summary(desk):
    desk.register_dataset(PIPELINE, DATASET, "source", {"b": {}, "a": {}}, {"max_age_hours": 6}, {"min_row_count": 2}, 2)
    found = desk.contract(DATASET).first()
    assert (found["contract_version"], found["schema_columns"], found["freshness_max_age_hours"]) == (2, ["b", "a"], 6.0)
    assert found["role"] == "source" and json.loads(found["quality_rules"]) == {"min_row_count": 2}
    assert desk.contract(DATASET, PIPELINE).count() == 1 and desk.contract(DATASET, "other").isEmpty()


def test_passing_run(desk, write_csv):
    health = desk.submit_run(run("run-1", write_csv("a.csv", tide_rows()))).first()
    assert (health["status"], health["failure_reason"], health["source_row_count"]) == ("passed", None, 5)
    assert states(health) == {
        "source_readability": "passed",
        "schema_compatibility": "passed",
        "target_schema_compatibility": "skipped",
        "row_count": "passed",
        "freshness": "passed",
    }
    assert health["incidents"] == [] and health["contract_version"] == 1
    assert datetime(2026, 8, 1, 12) < health["started_at"] < health["ended_at"] < datetime(2026, 8, 1, 12, 0, 1)
    assert [c["check_order"] for c in health["checks"]] == [1, 2, 3, 4, 5]


def test_late_run_and_acknowledgement(desk, write_csv):
    health = desk.submit_run(run("run-late", write_csv("a.csv", tide_rows(day="2026-06-01")))).first()
    assert health["status"] == "late" and "stale" in health["failure_reason"]
    incident = health["incidents"][0]
    assert (incident["incident_type"], incident["severity"], incident["owner"], incident["status"]) == (
        "late_arrival", "high", "data-platform", "open",
    )
    assert desk.list_incidents(PIPELINE).count() == 1
    assert desk.acknowledge("run-late") == 1
    assert desk.acknowledge("run-late") == 0
    assert desk.list_incidents(PIPELINE).count() == 0
    assert desk.run_health(PIPELINE, "run-late").first()["incidents"][0]["status"] == "acknowledged"
    with pytest.raises(Rejected, match="not found"):
        desk.acknowledge("absent")


def test_failed_run_raises_alerts(desk, write_csv):
    rows = tide_rows(moon_phase="7", level_mm=lambda i: "" if i == 2 else "5")
    health = desk.submit_run(run("run-drift", write_csv("a.csv", rows))).first()
    assert health["status"] == "failed" and health["incidents"][0]["severity"] == "medium"
    firing = {r["rule"]: r["firing"] for r in desk.alerts().collect()}
    assert firing == {
        "alert-pipeline-failed": True,
        "alert-freshness-exceeded": False,
        "alert-open-incidents": True,
        "alert-schema-drift": True,
    }


def test_same_run_id_is_not_evaluated_again(desk, write_csv):
    first = desk.submit_run(run("run-1", write_csv("a.csv", tide_rows()))).first()
    again = desk.submit_run(run("run-1", write_csv("b.csv", tide_rows(day="2026-01-01")))).first()
    assert first == again
    assert desk.store.runs().count() == 1 and desk.store.checks().count() == 5


def test_contract_version_is_chosen(desk, write_csv):
    tight = {**TIDE_QUALITY, "max_row_count": 2}
    desk.register_dataset(PIPELINE, DATASET, "source", TIDE_SCHEMA, TIDE_FRESHNESS, tight, 2)
    path = write_csv("a.csv", tide_rows())
    one = desk.submit_run(run("v1", path, contract_version=1)).first()
    two = desk.submit_run(run("v2", path, contract_version=2)).first()
    newest = desk.submit_run(run("newest", path)).first()
    assert [(h["contract_version"], states(h)["row_count"]) for h in (one, two, newest)] == [
        (1, "passed"), (2, "failed"), (2, "failed"),
    ]
    with pytest.raises(Rejected, match="Contract version 99 not found for dataset 'tide_readings'."):
        desk.submit_run(run("v99", path, contract_version=99))


def test_rejections_leave_no_run(desk, write_csv):
    path = write_csv("a.csv", tide_rows())
    cases = [
        (run("x", "/nonexistent.csv"), "Cannot resolve source: File not found"),
        (run("x", path, target="/nonexistent.csv"), "Cannot resolve target: File not found"),
        (Submission("absent", "x", path, DATASET), "Pipeline 'absent' not registered. Register it first."),
        (Submission(PIPELINE, "x", path, "absent"), "Dataset 'absent' not found in pipeline"),
    ]
    for submission, message in cases:
        with pytest.raises(Rejected, match=message):
            desk.submit_run(submission)
    assert desk.store.runs().isEmpty()


def test_unreadable_source_can_be_recorded(spark, tmp_path):
    desk = ContractDesk(spark, str(tmp_path / "control"), clock=ticking(), on_unreadable="record")
    desk.register_pipeline(PIPELINE, "owner")
    desk.register_dataset(PIPELINE, DATASET, "source", TIDE_SCHEMA, {}, {})
    health = desk.submit_run(run("gone", "/nonexistent.csv")).first()
    assert health["status"] == "failed" and states(health) == {"source_readability": "failed"}
    assert health["source_row_count"] is None
    assert "Source not readable: File not found" in health["failure_reason"]


def test_target(desk, write_csv):
    target_schema = {"gauge_no": {"type": "integer", "nullable": False}, "station_code": {"type": "string"}}
    desk.register_dataset(PIPELINE, "tide_target", "target", target_schema, {}, {})
    source = write_csv("s.csv", tide_rows(2))
    target = write_csv("t.csv", [{"gauge_no": "x", "station_code": "A"}])
    health = desk.submit_run(run("t", source, target=target, target_dataset="tide_target")).first()
    checks = {c["check_type"]: c for c in health["checks"]}
    assert checks["target_schema_compatibility"]["message"] == (
        "Type violations (1): Type mismatch in 'gauge_no' at row 1: expected integer, got 'x'"
    )
    assert "Source-target mismatch: 2 vs 1 (50.0% diff, max 5%)" in checks["row_count"]["message"]
    assert health["target_row_count"] == 1
    # Without a target contract only the counts are compared.
    other = desk.submit_run(run("u", source, target=source)).first()
    assert states(other)["target_schema_compatibility"] == "skipped" and other["target_row_count"] == 2


def test_many_runs_at_once(desk, write_csv):
    good, old = write_csv("g.csv", tide_rows()), write_csv("o.csv", tide_rows(day="2026-05-01"))
    wanted = [run(f"b{i}", good if i % 2 else old) for i in range(6)]
    rejected = desk.submit_runs([*wanted, wanted[0], run("bad", "/nonexistent.csv")])
    assert [(s.run_id, m) for s, m in rejected] == [
        ("bad", "Cannot resolve source: File not found: /nonexistent.csv")
    ]
    found = {r["run_id"]: r["status"] for r in desk.list_runs(PIPELINE).collect()}
    assert found == {f"b{i}": "passed" if i % 2 else "late" for i in range(6)}
    assert desk.pipeline_health(PIPELINE).first()["run_id"] == "b5"
    assert desk.list_runs(PIPELINE, status="late", limit=2).count() == 2
    metrics = desk.metrics().first().asDict(recursive=True)
    assert metrics["runs_24h"]["by_status"] == {"passed": 3, "late": 3}
    assert metrics["checks_24h"] == {"failed_by_type": {"freshness": 3}, "total_failed": 3}
    assert metrics["incidents"]["open"] == 3 and metrics["pipelines"] == {"total": 1, "active": 1}


def test_alert_log(desk):
    desk.receive_alert({"status": "firing", "alerts": [{"labels": {"alertname": "A"}}]})
    desk.receive_alert({"alerts": []})
    log = desk.notification_log().collect()
    assert [(r["alert_name"], r["status"]) for r in log] == [(None, "unknown"), ("A", "firing")]
    assert desk.metrics().first()["notifications_24h"]["total"] == 2


def test_running_limit(desk, write_csv, spark):
    from pyspark.sql import functions as F

    runs = spark.range(3).select(
        F.lit(PIPELINE).alias("pipeline"), F.concat(F.lit("busy-"), F.col("id")).alias("run_id"),
        F.lit("running").alias("status"),
        *[F.lit(None).cast(k).alias(n) for n, k in (("source_row_count", "bigint"), ("target_row_count", "bigint"),
          ("failure_reason", "string"), ("contract_version", "int"))],
        F.lit("2026-08-01 00:00:00").cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("ended_at"), "id", F.lit(1).alias("event_no"),
    ).withColumnRenamed("id", "seq")
    desk.store.append("runs", runs)
    with pytest.raises(Rejected, match="Concurrent run limit exceeded for 'harbour_gauges': 3/3"):
        desk.submit_run(run("one more", write_csv("a.csv", tide_rows())))
    assert desk.metrics().first()["runs_24h"]["stuck"] == 3


def test_a_source_that_fails_in_its_scan_fails_its_own_run_only(desk, write_csv):
    desk.register_pipeline("other", "owner")
    desk.register_dataset("other", DATASET, "source", TIDE_SCHEMA, TIDE_FRESHNESS, TIDE_QUALITY)
    bad = "query://SELECT raise_error('lost') AS gauge_no FROM range(3) WHERE id > 0"
    wanted = [run(f"bad-{i}", bad) for i in range(3)] + [Submission("other", "good", write_csv("a.csv", tide_rows()), DATASET)]
    assert desk.submit_runs(wanted) == []
    found = {r["run_id"]: r["status"] for p in (PIPELINE, "other") for r in desk.list_runs(p).collect()}
    assert found == {"bad-0": "failed", "bad-1": "failed", "bad-2": "failed", "good": "passed"}
    health = desk.run_health(PIPELINE, "bad-0").first()
    assert states(health) == {"source_readability": "failed"} and len(health["incidents"]) == 1
    assert desk.submit_runs([run("next", write_csv("b.csv", tide_rows()))]) == []


def test_a_run_of_a_driver_that_died_can_be_resumed(desk, write_csv, monkeypatch):
    one = run("r", write_csv("a.csv", tide_rows(day="2026-06-01")))
    append = desk.store.append

    def dies(table, rows, time=None):
        if table == "runs" and "event_no" in rows.columns and rows.first()["event_no"] == 2:
            raise KeyboardInterrupt
        append(table, rows, time)

    monkeypatch.setattr(desk.store, "append", dies)
    with pytest.raises(KeyboardInterrupt):
        desk.submit_runs([one])
    monkeypatch.setattr(desk.store, "append", append)
    assert desk.submit_run(one).first()["status"] == "running"
    desk.submit_runs([one], resume=True)
    health = desk.run_health(PIPELINE, "r").first()
    assert health["status"] == "late" and len(health["checks"]) == 5 and len(health["incidents"]) == 1
    assert desk.store.runs().count() == 1 and desk.store.checks().count() == 5 and desk.store.incidents().count() == 1


def test_the_second_attempt_replaces_the_first(desk, write_csv, monkeypatch):
    """The first dies after it has stored five results and an incident; by the second the source is fine."""
    path = write_csv("a.csv", tide_rows(day="2026-06-01"))
    append = desk.store.append

    def dies(table, rows, time=None):
        if table == "runs" and rows.first()["event_no"] == 2:
            raise KeyboardInterrupt
        append(table, rows, time)

    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(desk.store, "append", dies)
        desk.submit_runs([run("r", path)])
    assert desk.list_incidents(PIPELINE).count() == 1
    write_csv("a.csv", tide_rows())
    desk.submit_runs([run("r", path)], resume=True)
    health = desk.run_health(PIPELINE, "r").first()
    assert health["status"] == "passed" and {c["status"] for c in health["checks"]} <= {"passed", "skipped"}
    assert [i["status"] for i in health["incidents"]] == ["resolved"] and desk.list_incidents(PIPELINE).isEmpty()
    assert {r["event_no"] for r in desk.store.log("runs").collect()} == {1, 3, 4}
    assert {r["value"] for r in desk.alerts().collect()} == {0}


def test_a_target_that_fails_in_its_scan_fails_its_own_checks(desk, write_csv):
    desk.register_dataset(PIPELINE, "copies", "target", TIDE_SCHEMA, TIDE_FRESHNESS, TIDE_QUALITY)
    bad = "query://SELECT raise_error('target lost') AS gauge_no FROM range(3) WHERE id > 0"
    one = Submission(PIPELINE, "t", write_csv("a.csv", tide_rows()), DATASET, bad, "copies")
    other = Submission(PIPELINE, "u", bad.replace("target", "source"), DATASET, write_csv("b.csv", tide_rows()), "copies")
    assert desk.submit_runs([one, other]) == []
    health = desk.run_health(PIPELINE, "t").first()
    assert states(health) == {
        "source_readability": "passed", "schema_compatibility": "passed", "target_schema_compatibility": "failed",
        "row_count": "failed", "freshness": "passed",
    }
    said = {c["check_type"]: c["message"] for c in health["checks"]}
    assert "target lost" in said["target_schema_compatibility"] and "SparkException" not in said["target_schema_compatibility"]
    assert said["row_count"].startswith("Target not readable: Failed to read: ")
    other = desk.run_health(PIPELINE, "u").first()
    assert states(other) == {"source_readability": "failed"} and "source lost" in other["checks"][0]["message"]


def two_desks(spark, desk, submissions, monkeypatch, evaluated):
    """Submit each list at once, from desks and sessions of their own, whose runs never end."""
    from threading import Barrier, Thread

    def keep(self, accepted, *rest):
        evaluated.extend((s.run_id, threads.index(current_thread())) for s, *_ in accepted)

    from threading import current_thread

    monkeypatch.setattr(ContractDesk, "_conclude", keep)
    start, rejected = Barrier(len(submissions)), []

    def submit(wanted):
        own = ContractDesk(spark.newSession(), desk.store.root, clock=desk.clock)
        start.wait()
        for one in wanted:
            rejected.extend(own.submit_runs([one]))

    threads = [Thread(target=submit, args=(wanted,)) for wanted in submissions]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    return rejected


def test_two_drivers_begin_a_run_once_and_keep_the_limit(spark, desk, write_csv, monkeypatch):
    source, evaluated = write_csv("a.csv", tide_rows()), []
    lists = [[run("same", source), run(f"own-{i}", source), run(f"more-{i}", source)] for i in range(2)]
    rejected = two_desks(spark, desk, lists, monkeypatch, evaluated)
    begun = [run_id for run_id, _ in evaluated]
    assert begun.count("same") == 1 and len(begun) == len(set(begun)) == model.MAX_CONCURRENT_RUNS
    assert desk.store.log("runs").count() == 3 and len(rejected) == 2
    assert all("Concurrent run limit exceeded" in reason for _, reason in rejected)


def test_a_claim_of_a_dead_driver_is_not_waited_for_forever(desk, monkeypatch):
    from datetime import timedelta

    from pactline.sources import claims

    now = desk.store.clock()
    monkeypatch.setattr(desk.store, "clock", lambda: now - timedelta(minutes=6))
    claims._write(desk.store, "dead", claims.ENTER, ["p"], 0)
    monkeypatch.setattr(desk.store, "clock", lambda: now)
    claims._write(desk.store, "alive", claims.ENTER, ["p"], 0)
    claims._write(desk.store, "alive", claims.NUMBER, ["p"], 7)
    claims._write(desk.store, "gone", claims.ENTER, ["p"], 0)
    claims._write(desk.store, "gone", claims.LEAVE, ["p"], 0)
    assert claims.waiting(desk.store, ["p", "x"]) == {"alive": (claims.NUMBER, 7)} and claims.waiting(desk.store, ["x"]) == {}
    with claims.turn(desk.store, ["x"]) as check:
        check()
        monkeypatch.setattr(desk.store, "clock", lambda: now + timedelta(minutes=3))
        with pytest.raises(claims.TurnLost):
            check()


def test_checks_and_incidents_of_any_type_count(spark):
    from pactline.plans.runs import finalize_runs, run_verdicts

    shape = "pipeline string, run_id string, check_order int, check_type string, status string, expected string, observed string, message string, error_category string"
    rows = [("p", "a", 9, "null_rate", "failed", None, None, "too many nulls", "unknown")] * 2 + [
        ("p", "a", 1, "source_readability", "passed", None, None, None, None), ("p", "b", 1, "source_readability", "passed", None, None, None, None)]
    frame = spark.createDataFrame(rows, shape)
    got = {r["run_id"]: (r["failed_checks"], r["status"]) for r in run_verdicts(frame).collect()}
    assert got == {"a": (1, "failed"), "b": (0, "passed")}
    final = {r["run_id"]: (r["status"], r["failure_reason"], r["error_category"]) for r in finalize_runs(frame).collect()}
    assert final["a"] == ("failed", "too many nulls", "unknown")
