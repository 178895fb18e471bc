from datetime import date, datetime

from pyspark.sql import functions as F

from pactline import model
from pactline.operators import duplicate_rows
from pactline.plans.alerts import RULES, evaluate, rule_rows, states
from pactline.sources.store import ControlStore
from pactline.streaming import count_distinct_keys, count_rows, stream_rows, unique_key_totals, watch_alerts
from pactline.streaming.alerts import still_counting

SHAPE = "id string, site string"


def write(spark, path, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").option("header", "true").csv(str(path))


def pump(spark, tmp_path, path):
    rows = stream_rows(spark, str(path), SHAPE)
    count_rows(rows, f"{tmp_path}/rows", f"{tmp_path}/c1").awaitTermination()
    count_distinct_keys(rows, ["id", "site"], f"{tmp_path}/keys", f"{tmp_path}/c2").awaitTermination()
    return tuple(unique_key_totals(spark, f"{tmp_path}/rows", f"{tmp_path}/keys").first())


def test_counts_follow_arrivals(spark, tmp_path):
    path = tmp_path / "in"
    write(spark, path, [("1", "a"), ("1", "a"), ("2", None), ("2", None), ("2", "a")])
    assert pump(spark, tmp_path, path) == (5, 2)
    # Duplicates of earlier files are found without reading them again.
    write(spark, path, [("1", "a"), ("3", "b"), ("2", None)])
    assert pump(spark, tmp_path, path) == (8, 4)
    whole = spark.read.schema(SHAPE).option("header", "true").csv(str(path))
    assert duplicate_rows(whole, ["id", "site"]).first()["duplicates"] == 4


def test_hot_key_is_reduced_before_the_shuffle(spark, tmp_path):
    write(spark, tmp_path / "in", [("1", "a")] * 3000 + [(str(i), "b") for i in range(6000)])
    assert pump(spark, tmp_path, tmp_path / "in") == (9000, 2999)
    rows = stream_rows(spark, str(tmp_path / "in"), SHAPE)
    query = count_distinct_keys(rows, ["id"], f"{tmp_path}/k", f"{tmp_path}/c3")
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "partial_min" in plan.split("Exchange")[-1]


def test_restart_without_arrivals_changes_nothing(spark, tmp_path):
    path = tmp_path / "in"
    write(spark, path, [("1", "a"), ("1", "a")])
    assert pump(spark, tmp_path, path) == pump(spark, tmp_path, path) == (2, 1)


def test_absent_key_column_reads_as_empty(spark, tmp_path):
    write(spark, tmp_path / "in", [("1", "a"), ("2", "b")])
    rows = stream_rows(spark, str(tmp_path / "in"), SHAPE)
    count_rows(rows, f"{tmp_path}/rows", f"{tmp_path}/c1").awaitTermination()
    count_distinct_keys(rows, ["absent"], f"{tmp_path}/keys", f"{tmp_path}/c2").awaitTermination()
    assert tuple(unique_key_totals(spark, f"{tmp_path}/rows", f"{tmp_path}/keys").first()) == (2, 1)


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,site\n1,"a\nb"\n2,"say ""hi"""\n')
    rows = stream_rows(spark, str(tmp_path / "in"), SHAPE, multiLine="true")
    count_rows(rows, f"{tmp_path}/rows", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/rows").agg(F.sum("n")).first()[0] == 2


def test_alerts_follow_runs(spark, tmp_path):
    store = ControlStore(spark, str(tmp_path / "control"))
    store.append("pipelines", spark.createDataFrame([("p", "ann", True, 1)], model.PIPELINES))

    def add(run_id, status, seq):
        row = ("p", run_id, status, 1, None, "why", 1, datetime(2026, 8, seq), datetime(2026, 8, seq), seq, 2)
        store.append("runs", spark.createDataFrame([row], model.RUNS))

    def states():
        watch_alerts(store, f"{tmp_path}/out", f"{tmp_path}/c", availableNow=True).awaitTermination()
        found = spark.read.parquet(f"{tmp_path}/out")
        newest = found.where(F.col("epoch") == found.agg(F.max("epoch")).first()[0])
        return {r["rule"]: r["firing"] for r in newest.collect()}

    add("a", "failed", 1)
    assert states()["alert-pipeline-failed"]
    add("b", "passed", 2)
    assert not states()["alert-pipeline-failed"]
    assert store.log("runs", since=date(2026, 9, 1)).isEmpty()


def add_runs(store, *rows):
    """(pipeline, run_id, status, seq, event_no)"""
    full = [(p, r, s, 1, None, None, 1, datetime(2026, 8, 1 + n % 28), datetime(2026, 8, 1 + n % 28), n, e) for p, r, s, n, e in rows]
    store.append("runs", store.spark.createDataFrame(full, model.RUNS))


def add_checks(store, *rows, attempt=1):
    """(pipeline, run_id, check_type, status, age)"""
    full = [
        (p, r, model.CHECK_ORDER.index(t) + 1, t, s, '{"max_age_hours": 24}', '{"age_hours": %s}' % age, "m", None, attempt)
        for p, r, t, s, age in rows
    ]
    store.append("checks", store.spark.createDataFrame(full, model.CHECKS), date(2026, 8, 1))


def add_incidents(store, *rows):
    """(pipeline, run_id, type, status, event_no)"""
    full = [(p, r, t, "high", "ann", s, True, "why", datetime(2026, 8, 3), e) for p, r, t, s, e in rows]
    store.append("incidents", store.spark.createDataFrame(full, model.INCIDENTS))


def alert_arrivals(store):
    """Arrivals of several triggers, most of them out of order."""
    f, s, t = model.FRESHNESS, model.SCHEMA_COMPATIBILITY, model.TARGET_SCHEMA_COMPATIBILITY
    add_runs(store, ("p", "a", "running", 1, 1), ("p", "a", "failed", 1, 2), ("q", "a", "running", 2, 1), ("ghost", "g", "failed", 3, 2))
    add_checks(store, ("p", "a", s, "failed", 1), ("p", "a", s, "failed", 1), ("q", "later", f, "failed", 90), ("q", "a", f, "failed", 3))
    add_incidents(store, ("p", "a", "contract_violation", "open", 0), ("q", "unknown", "late_arrival", "open", 0))
    yield {"failed_run": 1, "stale_data": 0, "open_incidents": 1, "schema_drift": 1}
    # The check of this run came before it; an older run of p ends last; an unknown run's incident counts from now on.
    add_runs(store, ("q", "later", "late", 5, 2), ("p", "old", "failed", 0, 2), ("q", "unknown", "passed", 4, 2))
    add_checks(store, ("p", "old", t, "failed", 1))
    yield {"failed_run": 1, "stale_data": 1, "open_incidents": 2, "schema_drift": 1}
    # The acknowledgement is read again after a repeated first event; p's next run is fine.
    add_incidents(store, ("p", "a", "contract_violation", "acknowledged", 1), ("p", "a", "late_arrival", "open", 0))
    add_incidents(store, ("p", "a", "contract_violation", "open", 0))
    add_runs(store, ("p", "b", "passed", 9, 2))
    yield {"failed_run": 0, "stale_data": 1, "open_incidents": 2, "schema_drift": 0}
    add_checks(store, ("p", "b", t, "failed", 1), ("p", "b", s, "failed", 1), ("p", "a", f, "failed", 99))
    yield {"failed_run": 0, "stale_data": 1, "open_incidents": 2, "schema_drift": 2}
    # Both latest runs are evaluated again: nothing of their first attempts counts.
    add_checks(store, ("p", "b", t, "failed", 1), ("p", "b", s, "passed", 1), ("q", "later", model.SOURCE_READABILITY, "failed", 1), attempt=2)
    yield {"failed_run": 0, "stale_data": 0, "open_incidents": 2, "schema_drift": 1}


def test_triggers_read_arrivals_and_state_only(spark, tmp_path, monkeypatch):
    store = ControlStore(spark, str(tmp_path / "control"))
    store.append("pipelines", spark.createDataFrame([("p", "ann", True, 1), ("q", "bob", True, 2), ("idle", "eve", True, 3)], model.PIPELINES))
    whole = ControlStore(spark, store.root)
    for table in ("runs", "checks", "incidents"):
        monkeypatch.setattr(store, table, None)
    for epoch, expected in enumerate(alert_arrivals(store)):
        query = watch_alerts(store, f"{tmp_path}/out", f"{tmp_path}/c", availableNow=True)
        query.awaitTermination()
        found = spark.read.parquet(f"{tmp_path}/out/epoch={epoch}")
        rules = {uid: name for name, (uid, *_) in RULES.items()}
        assert {rules[r["rule"]]: r["value"] for r in found.collect()} == expected
        tables = whole.pipelines(), whole.runs(), whole.checks(), whole.incidents()
        for batch in (states(*tables), evaluate(rule_rows(*tables))):
            assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, found.select(*batch.columns).collect()))
        progress = query.lastProgress
        # A run's state is touched only when something of it arrives.
        assert progress["numInputRows"] <= 10 and progress["stateOperators"][0]["numRowsUpdated"] <= 6
    live = spark.read.parquet(f"{tmp_path}/c/live/{epoch % 2}")
    assert {(r["pipeline"], r["run_id"]) for r in still_counting(live).collect()} == {
        ("p", "b"), ("p", "a"), ("q", "later"), ("q", "unknown"), ("ghost", "g")
    }


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    """A batch whose commit was lost is evaluated again, from what the batch before it left."""
    store = ControlStore(spark, str(tmp_path / "control"))
    store.append("pipelines", spark.createDataFrame([("p", "ann", True, 1), ("q", "bob", True, 2)], model.PIPELINES))
    for _ in alert_arrivals(store):
        watch_alerts(store, f"{tmp_path}/out", f"{tmp_path}/c", availableNow=True).awaitTermination()
    before = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/epoch=4").collect()))
    for name in ("4", ".4.crc"):
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    watch_alerts(store, f"{tmp_path}/out", f"{tmp_path}/c", availableNow=True).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/epoch=4").collect())) == before
