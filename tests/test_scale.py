"""Plans and hot keys: what has to hold when the data is large."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from pactline import ColumnRule, Contract
from pactline.operators import contract_checks, contract_checks_by_key, duplicate_rows, latest_by_key, measure
from pactline.plans import admission, history, metrics, runs
from pactline.sources.resolve import from_frame, resolve

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lines(spark):
    return resolve(spark, f"local://{SF}/lineitem.parquet")


def contract_of_width(n):
    return Contract(tuple(ColumnRule(f"c{i}", "integer", False) for i in range(n)))


def test_only_needed_columns_are_read(lines):
    contract = Contract((ColumnRule("l_orderkey", "integer", False),), timestamp_column="l_shipdate")
    text = plan(measure(lines, contract, samples=False))
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in text
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    keys = plan(duplicate_rows(lines.frame, ["l_orderkey", "l_linenumber"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in keys
    assert "partial_count" in keys


def test_number_of_aggregates_does_not_grow_with_the_columns(spark):
    def aggregates(n):
        frame = spark.range(1).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(n)])
        return len(measure(from_frame(frame), contract_of_width(n)).columns)

    assert aggregates(3) == aggregates(60)


def test_wide_contract(spark):
    width = 300
    frame = spark.range(2000).select(*[(F.col("id") + i).cast("string").alias(f"c{i}") for i in range(width)])
    frame = frame.withColumn("c250", F.when(F.col("c0") == "7", "x").otherwise(F.col("c250")))
    found = measure(from_frame(frame), contract_of_width(width)).first()
    assert (found["row_count"], found["null_violations"], found["type_violations"]) == (2000, 0, 1)
    assert found["first_type"]["value"] == "x"


def test_no_python_and_no_pair_joins(spark, lines):
    contract = Contract(
        (ColumnRule("l_orderkey", "integer"),), unique_keys=("l_orderkey",), timestamp_column="l_shipdate"
    )
    for frame in (
        contract_checks(lines, contract, AS_OF, lines, contract),
        contract_checks_by_key(lines, contract, AS_OF, ["l_suppkey"]),
    ):
        text = plan(frame)
        for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
            assert word not in text


@pytest.fixture
def hot(spark):
    """A third of the rows under one key, and within it half under one value."""
    third = F.col("id") % 3 == 0
    return spark.range(90_000).select(
        F.when(third, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("site"),
        F.when(third & (F.col("id") % 2 == 0), "same").otherwise(F.col("id").cast("string")).alias("item"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("t"),
    )


def test_hot_keys_arrive_reduced(hot):
    for frame in (
        duplicate_rows(hot, ["site"]),
        duplicate_rows(hot, ["item"], ["site"]),
        latest_by_key(hot, "site", "t"),
    ):
        assert "partial_" in plan(frame)
    assert duplicate_rows(hot, ["site"]).first()["duplicates"] == 90_000 - 5001
    per_site = {r["site"]: r["duplicates"] for r in duplicate_rows(hot, ["item"], ["site"]).collect()}
    assert per_site["hot"] == 14_999 and sum(per_site.values()) == 14_999
    assert {r["site"]: r["row_count"] for r in latest_by_key(hot, "site", "t").collect()}["hot"] == 30_000


def control(spark, n=30_000):
    """A third of the runs belong to one flow."""
    run = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 997)).alias("pipeline"),
        F.concat(F.lit("r"), "id").alias("run_id"),
        F.when(F.col("id") % 10 == 0, "running").otherwise("passed").alias("status"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("started_at"),
        F.timestamp_seconds(F.col("id") + 5).cast("timestamp_ntz").alias("ended_at"),
        F.lit(1).cast("bigint").alias("source_row_count"),
        F.lit(1).cast("bigint").alias("target_row_count"),
        F.lit(None).cast("string").alias("failure_reason"),
        F.lit(1).alias("contract_version"),
        F.col("id").alias("seq"),
    )
    return run


def test_latest_and_pages_of_a_hot_flow(spark):
    rows = control(spark)
    for by in ("started_at", "seq"):
        frame = history.latest_runs(rows, by=by)
        assert "partial_max" in plan(frame) and "Window" not in plan(frame)
        assert frame.where("pipeline = 'hot'").first()["run_id"] == "r29997"
    page = history.list_runs(rows, limit=5)
    assert "WindowGroupLimit" in plan(page)
    hot_page = [r["run_id"] for r in page.where("pipeline = 'hot'").collect()]
    assert sorted(hot_page) == sorted(f"r{29_997 - 3 * i}" for i in range(5))


def test_a_run_with_very_many_results(spark):
    results = spark.range(60_000).select(
        F.lit("hot").alias("pipeline"),
        F.when(F.col("id") % 3 == 0, "r0").otherwise(F.concat(F.lit("r"), F.col("id"))).alias("run_id"),
        (F.col("id") % 2 + 4).cast("int").alias("check_order"),
        F.when(F.col("id") % 2 == 0, "row_count").otherwise("freshness").alias("check_type"),
        F.when(F.col("id") % 4 == 1, "failed").otherwise("passed").alias("status"),
        F.lit("m").alias("message"),
        F.lit(None).cast("string").alias("observed"),
        F.lit(None).cast("string").alias("error_category"),
    )
    for frame in (runs.run_verdicts(results), runs.finalize_runs(results)):
        assert "collect" not in plan(frame).lower() and "partial_max" in plan(frame)
        assert frame.where("run_id = 'r0'").first()["status"] == "late"
    rows = control(spark, 10).withColumn("pipeline", F.lit("hot"))
    counted = metrics.failed_check_counts(results, rows, datetime(1970, 1, 1))
    assert {r["check_type"]: r["failed"] for r in counted.collect()} == {"freshness": 5_000 + 2}


def test_admission_of_a_hot_flow(spark):
    rows = control(spark)
    decided = admission.admit(rows.select("pipeline", "run_id"), rows)
    assert decided.where("pipeline = 'hot' AND NOT admitted").count() == 10_000
    assert decided.count() == 30_000
