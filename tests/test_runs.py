import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pactline import model
from pactline.functions.text import run_id
from pactline.plans import admission, alerts, dashboards, history, metrics, registry, runs

CHECK = "pipeline string, run_id string, check_order int, check_type string, status string, message string"
NOON = datetime(2026, 8, 1, 12)


def check_rows(spark, states, run_id="r1"):
    rows = [
        ("p", run_id, i + 1, kind, state, f"{kind} says {state}")
        for i, (kind, state) in enumerate(zip(model.CHECK_ORDER, states))
        if state
    ]
    return spark.createDataFrame(rows, CHECK).withColumns(
        {
            "expected": F.lit(None).cast("string"),
            "observed": F.lit('{"source_row_count": 4, "target_row_count": null}'),
            "error_category": F.when(F.col("status") == "failed", F.col("check_type")),
        }
    )


@pytest.mark.parametrize(
    "states, status, reason",
    [
        ("passed passed skipped passed passed", "passed", None),
        ("passed passed skipped passed failed", "late", "freshness says failed"),
        ("passed failed skipped passed passed", "failed", "schema_compatibility says failed"),
        (
            "passed failed skipped passed failed",
            "failed",
            "schema_compatibility says failed; freshness says failed",
        ),
        ("failed", "failed", "source_readability says failed"),
    ],
)
def test_status_and_reason(spark, states, status, reason):
    rows = check_rows(spark, states.split())
    found = runs.finalize_runs(rows).first()
    assert (found["status"], found["failure_reason"]) == (status, reason)
    assert runs.run_verdicts(rows).first()["status"] == status
    counted = 4 if "passed" in states.split()[3:4] else None
    assert (found["source_row_count"], found["target_row_count"]) == (counted, None)


def test_results_written_twice_count_once(spark):
    rows = check_rows(spark, "passed passed skipped passed failed".split())
    twice = rows.unionByName(rows)
    assert runs.finalize_runs(twice).first()["status"] == "late"
    assert runs.run_verdicts(twice).first()["failed_checks"] == 1


def test_missing_message_gets_a_default(spark):
    rows = check_rows(spark, ["passed", "failed"]).withColumn("message", F.lit(None).cast("string"))
    assert runs.finalize_runs(rows).first()["failure_reason"] == "schema_compatibility failed"


def test_stop_at_unreadable(spark):
    rows = check_rows(spark, ["failed", "passed", "skipped", "passed", "passed"]).unionByName(
        check_rows(spark, ["passed", "failed"], "r2")
    )
    kept = runs.stop_at_unreadable(rows).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in kept} == {"r1": 1, "r2": 2}


def run_rows(spark, *rows):
    shape = "pipeline string, run_id string, status string, started_at timestamp_ntz, ended_at timestamp_ntz, seq bigint"
    return spark.createDataFrame(list(rows), shape).withColumns(
        {
            "source_row_count": F.lit(1).cast("bigint"),
            "target_row_count": F.lit(None).cast("bigint"),
            "failure_reason": F.when(F.col("status").isin("failed", "late"), "why"),
            "contract_version": F.lit(1),
        }
    )


@pytest.fixture
def flows(spark):
    return spark.createDataFrame([("p", "ann", True, 1), ("q", "bob", False, 2)], model.PIPELINES)


def test_incidents(spark, flows):
    rows = run_rows(
        spark,
        ("p", "a", "failed", NOON, NOON, 1),
        ("q", "b", "late", NOON, NOON, 2),
        ("q", "c", "passed", NOON, NOON, 3),
        ("p", "d", "running", NOON, None, 4),
    )
    found = {r["run_id"]: r for r in runs.derive_incidents(rows, flows).collect()}
    assert set(found) == {"a", "b"}
    assert [found["a"][k] for k in ("incident_type", "severity", "owner", "status", "retryable")] == [
        "contract_violation", "medium", "ann", "open", True,
    ]
    assert (found["b"]["incident_type"], found["b"]["severity"], found["b"]["owner"]) == ("late_arrival", "high", "bob")


def test_two_ideas_of_latest(spark):
    rows = run_rows(
        spark,
        ("p", "old", "passed", datetime(2026, 8, 1), NOON, 9),
        ("p", "new", "failed", datetime(2026, 8, 2), NOON, 5),
        ("p", "same", "failed", datetime(2026, 8, 2), NOON, 4),
    )
    assert history.latest_runs(rows).first()["run_id"] == "new"
    assert history.latest_runs(rows, by="seq").first()["run_id"] == "old"
    assert history.latest_runs(rows).columns == rows.columns


def test_pages(spark):
    rows = run_rows(spark, *[("p", f"r{i:03}", "passed", NOON, NOON, i) for i in range(150)])
    assert history.list_runs(rows, "p").count() == 20
    assert history.list_runs(rows, "p", limit=1000).count() == rows.where("pipeline = 'p'").count()
    assert [r["run_id"] for r in history.list_runs(rows, "p", limit=2, offset=3).collect()] == ["r146", "r145"]
    assert [r["run_id"] for r in history.list_runs(rows, limit=2, offset=3).orderBy("run_id").collect()] == [
        "r145", "r146",
    ]
    assert history.list_runs(rows, "p", status="failed").count() == 0
    with pytest.raises(ValueError, match="not a run status"):
        history.list_runs(rows, "p", status="FAILED")


def test_durations(spark):
    rows = run_rows(
        spark,
        ("p", "a", "passed", datetime(2026, 8, 1), datetime(2026, 8, 1, 0, 0, 1, 999_999), 1),
        ("p", "b", "running", datetime(2026, 8, 1), None, 2),
    )
    found = {r["run_id"]: r["duration_ms"] for r in history.list_runs(rows, "p").collect()}
    assert found == {"a": 1999, "b": None}


def test_metrics_edges(spark):
    rows = run_rows(
        spark,
        ("p", "edge", "passed", datetime(2026, 7, 31, 12), datetime(2026, 7, 31, 12, 0, 1), 1),
        ("p", "before", "failed", datetime(2026, 7, 31, 11, 59, 59), NOON, 2),
        ("p", "hour", "running", datetime(2026, 8, 1, 11), None, 3),
        ("p", "stuck", "running", datetime(2026, 8, 1, 10, 59, 59), None, 4),
        ("p", "quick", "passed", datetime(2026, 8, 1, 11), datetime(2026, 8, 1, 11, 0, 0, 5000), 5),
    )
    found = metrics.run_metrics(rows, NOON).first()
    assert found["total"] == 4 and found["by_status"] == {"running": 2, "passed": 2}
    assert (found["avg_duration_ms"], found["stuck"]) == (502, 1)
    none = metrics.run_metrics(rows.where("false"), NOON).first()
    assert tuple(none) == (0, {}, 0, 0)


def test_metrics_document_of_empty_tables(spark):
    empty = {name: spark.createDataFrame([], shape) for name, shape in model.CONTROL_TABLES.items()}
    found = metrics.operational_metrics(
        empty["pipelines"], empty["runs"], empty["checks"], empty["incidents"], empty["notifications"], NOON
    ).first().asDict(recursive=True)
    assert found == {
        "timestamp": "2026-08-01T12:00:00",
        "pipelines": {"total": 0, "active": 0},
        "runs_24h": {"total": 0, "by_status": {}, "avg_duration_ms": 0, "stuck": 0},
        "checks_24h": {"failed_by_type": {}, "total_failed": 0},
        "incidents": {"open": 0},
        "notifications_24h": {"total": 0, "by_status": {}},
    }


def test_first_writer_wins(spark, flows):
    offered = spark.createDataFrame(
        [("p", "eve", True, 5), ("n", "late", True, 7), ("n", "early", True, 6)], model.PIPELINES
    )
    found = {r["name"]: r["owner"] for r in registry.get_or_create(flows, offered, ["name"]).collect()}
    assert found == {"p": "ann", "q": "bob", "n": "early"}


def test_admission(spark):
    stored = run_rows(spark, *[("p", f"r{i}", "running", NOON, None, i) for i in range(12)],
                      *[("q", f"r{i}", "running", NOON, None, i) for i in range(2)])
    offered = spark.createDataFrame([("p", "x"), ("q", "x"), ("new", "x")], "pipeline string, run_id string")
    found = {r["pipeline"]: r for r in admission.admit(offered, stored).collect()}
    assert found["p"]["reason"] == "Concurrent run limit exceeded for 'p': 12/3"
    assert found["q"]["admitted"] and found["new"]["admitted"] and found["new"]["running"] == 0


def test_alert_documents(spark):
    payloads = spark.createDataFrame(
        [
            ('{"status": "firing", "alerts": [{"labels": {"alertname": "A"}}, {"labels": {"alertname": "B"}}]}', 1),
            ('{"alerts": []}', 2),
            ('{"alerts": [{"labels": {}}], "status": "resolved"}', 3),
            ("{}", 4),
        ],
        "payload string, seq bigint",
    ).withColumn("created_at", F.lit(NOON).cast("timestamp_ntz"))
    found = [(r["alert_name"], r["status"]) for r in alerts.notification_rows(payloads).orderBy("seq").collect()]
    assert found == [("A", "firing"), (None, "unknown"), (None, "resolved"), (None, "unknown")]
    log = history.notification_log(alerts.notification_rows(payloads), 2)
    assert [r["seq"] for r in log.collect()] == [4, 3]


def test_stale_rule_is_silent_without_an_age(spark, flows):
    latest = run_rows(spark, ("p", "a", "late", NOON, NOON, 1), ("q", "b", "late", NOON, NOON, 2))
    rows = spark.createDataFrame(
        [
            ("p", "a", '{"age_hours": 24.01}', '{"max_age_hours": 24}'),
            ("q", "b", '{"latest_timestamp": null, "parseable_timestamps": 0}', '{"max_age_hours": 24}'),
        ],
        "pipeline string, run_id string, observed string, expected string",
    ).withColumns({"check_type": F.lit("freshness"), "status": F.lit("failed")})
    found = alerts.stale_data(rows, latest, flows).collect()
    assert [(r["pipeline"], r["age_hours"], r["threshold_hours"]) for r in found] == [("p", 24.01, 24.0)]


def test_firing_states(spark, flows):
    rows = run_rows(spark, ("p", "a", "failed", NOON, NOON, 1), ("p", "b", "passed", NOON, NOON, 2))
    incidents = spark.createDataFrame([], model.INCIDENTS)
    checks = spark.createDataFrame([], model.CHECKS)
    states = {r["rule"]: (r["value"], r["firing"]) for r in alerts.evaluate(
        alerts.rule_rows(flows, rows, checks, incidents)).collect()}
    assert states == dict.fromkeys(
        ["alert-pipeline-failed", "alert-freshness-exceeded", "alert-open-incidents", "alert-schema-drift"],
        (0, False),
    )
    rows = rows.where("run_id = 'a'")
    found = alerts.evaluate({"failed_run": alerts.failed_runs(rows, flows)}).first()
    assert (found["value"], found["firing"], found["severity"]) == (1, True, "high")


def test_panel_orders(spark, flows):
    rows = run_rows(
        spark,
        ("q", "a", "passed", NOON, datetime(2026, 8, 1, 12, 0, 1, 600_000), 1),
        ("p", "b", "late", NOON, NOON, 2),
        ("gone", "c", "late", NOON, NOON, 3),
    )
    found = dashboards.latest_status(rows, flows).collect()
    assert [(r["pipeline"], r["duration_seconds"]) for r in found] == [("p", 0), ("q", 2)]
    codes = {r["pipeline"]: r["status_code"] for r in dashboards.run_history(rows, flows).collect()}
    assert codes == {"p": 1, "q": 0}
    ages = dashboards.hours_since_end(rows, flows, datetime(2026, 8, 1, 13)).collect()
    assert [r["pipeline"] for r in ages] == ["p", "q"] and ages[0]["age_hours"] == 1.0


def test_unended_runs_come_first_in_descending_panels(spark, flows):
    rows = run_rows(spark, ("p", "a", "running", NOON, None, 1), ("q", "b", "passed", NOON, NOON, 2))
    ages = dashboards.hours_since_end(rows, flows, datetime(2026, 8, 1, 13)).collect()
    assert [(r["pipeline"], r["age_hours"]) for r in ages] == [("p", None), ("q", 1.0)]
    assert dashboards.run_history(rows, flows).count() == 1


def test_run_ids_are_stable(spark):
    day = F.lit(datetime(2026, 8, 19, 7)).cast("timestamp_ntz")
    first, again, other = spark.range(1).select(
        run_id(day, F.lit("a")), run_id(day, F.lit("a")), run_id(day, F.lit("b"))
    ).first()
    assert first == again != other and re.fullmatch(r"2026-08-19-[0-9a-f]{6}", first)


def deep_runs(spark):
    """One pipeline with most runs, ties in time, runs without a time, a small pipeline."""
    from datetime import datetime, timedelta

    start = datetime(2026, 8, 1)
    rows = [("hot", f"h{i}", start + timedelta(minutes=i // 3) if i % 50 else None, i) for i in range(8000)]
    rows += [("cold", f"c{i}", start + timedelta(hours=i), i) for i in range(1200)]
    base = spark.createDataFrame(rows, "pipeline string, run_id string, started_at timestamp_ntz, seq bigint")
    rest = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in model.RUNS.split(", ")}
    return base.select("*", *[v.alias(k) for k, v in rest.items() if k not in base.columns]), rows


def test_deep_pages_equal_sorting(spark):
    runs, rows = deep_runs(spark)
    ordered = {p: sorted((r for r in rows if r[0] == p), key=lambda r: (r[2] is not None, r[2], r[3]) if r[2] else (False, None, r[3]), reverse=True) for p in ("hot", "cold")}
    for offset, limit in ((5000, 30), (7820, 60), (990, 20), (1150, 200), (7990, 5000)):
        expected = {p: [r[1] for r in ordered[p][offset : offset + limit]] for p in ordered}
        got = history.list_runs(runs, limit=limit, offset=offset).collect()
        assert {p: {r["run_id"] for r in got if r["pipeline"] == p} for p in ordered} == {p: set(e) for p, e in expected.items()}
        one = history.list_runs(runs, "hot", limit=limit, offset=offset).collect()
        assert [r["run_id"] for r in one] == expected["hot"]


def test_a_deep_page_ranks_hours_not_pipelines(spark):
    runs, _ = deep_runs(spark)
    found = history.list_runs(runs, limit=30, offset=5000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    ranked = next(line for line in windows if "row_number" in line)
    assert "__day" in ranked.split("windowspecdefinition(")[1].split("started_at")[0]
    # The other one adds up counts, one row for each hour of a pipeline.
    assert "sum(__rows" in next(line for line in windows if "row_number" not in line)
