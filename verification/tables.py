"""Control tables derived from the given tables, in Spark and in SQL.

Customers act as registered data flows, their orders as runs, the order lines
(one row per order and check type) as check results, events as alerts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline import model
from pactline.plans.alerts import notification_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _running() -> Column:
    return F.col("o_orderpriority") == "1-URGENT"


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("name"),
        F.col("n_name").alias("owner"),
        (F.col("c_acctbal") >= 0).alias("enabled"),
        F.col("c_custkey").alias("seq"),
    )


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (
        F.when(_running(), model.RUNNING)
        .when(F.col("o_orderstatus") == "F", model.FAILED)
        .when(F.col("o_orderstatus") == "P", model.LATE)
        .otherwise(model.PASSED)
    )
    seconds = (F.round(F.col("o_totalprice") * 100).cast("bigint") * 10 / 1000).cast("decimal(18,6)")
    zero = F.lit(0)
    ended = F.col("o_orderdate") + F.make_dt_interval(zero, zero, zero, seconds)
    bad = status.isin(model.FAILED, model.LATE)
    return orders_by_customer(spark, sf_dir).select(
        F.col("c_name").alias("pipeline"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        status.alias("status"),
        F.when(~_running(), F.col("c_custkey")).alias("source_row_count"),
        F.when(status == model.PASSED, F.floor("c_acctbal").cast("bigint")).alias("target_row_count"),
        F.when(bad, F.col("c_mktsegment")).alias("failure_reason"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("contract_version"),
        F.col("o_orderdate").alias("started_at"),
        F.when(~_running(), ended).alias("ended_at"),
        F.col("o_orderkey").alias("seq"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    order = F.col("l_linenumber") % 5 + 1
    # The flag's character code keeps the aggregation in fixed-width buffers.
    flag = F.char(F.col("flag"))
    types = F.array(*[F.lit(t) for t in model.CHECK_ORDER])
    folded = lineitem.groupBy("l_orderkey", order.alias("check_order")).agg(
        F.max(F.ascii("l_returnflag")).alias("flag"),
        F.count(F.lit(1)).alias("n"),
        F.min("l_quantity").cast("int").alias("low"),
        F.max("l_quantity").cast("int").alias("high"),
    )
    status = F.when(flag == "R", model.FAILED).when(flag == "A", model.PASSED).otherwise(model.SKIPPED)
    keys = orders_by_customer(spark, sf_dir).select("o_orderkey", "c_name")
    return folded.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("c_name").alias("pipeline"),
        F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("run_id"),
        "check_order",
        F.get(types, F.col("check_order") - 1).alias("check_type"),
        status.alias("status"),
        F.format_string('{"max_age_hours": %d}', "low").alias("expected"),
        F.format_string('{"age_hours": %d, "source_row_count": %d}', "high", "n").alias("observed"),
        F.format_string("lines %d", "n").alias("message"),
        F.when(flag == "R", F.format_string("category-%d", "check_order")).alias("error_category"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark, sf_dir).where(F.col("status").isin(model.FAILED, model.LATE))
    owners = pipelines(spark, sf_dir).select(F.col("name").alias("pipeline"), "owner")
    failed = F.col("status") == model.FAILED
    return found.join(owners, "pipeline").select(
        "pipeline",
        "run_id",
        F.when(failed, "contract_violation").otherwise("late_arrival").alias("incident_type"),
        F.when(failed, "medium").otherwise("high").alias("severity"),
        "owner",
        F.when(F.col("contract_version") == 5, model.ACKNOWLEDGED).otherwise(model.OPEN).alias("status"),
        F.lit(True).alias("retryable"),
        F.col("failure_reason").alias("failure_summary"),
        F.col("ended_at").alias("first_observed_at"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.format_string(
        '{"status": "%s", "alerts": [{"labels": {"alertname": "%s"}}, {"labels": {}}]}',
        F.when(F.col("event_type") == "error", "firing").otherwise("resolved"),
        "event_type",
    )
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", F.col("props")).otherwise(document).alias("payload"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notification_rows(payloads(spark, sf_dir))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract version per customer and order priority."""
    rows = orders_by_customer(spark, sf_dir).select(
        F.col("c_name").alias("pipeline"),
        F.lit("orders").alias("dataset"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("version"),
        F.format_string(
            '{"o_orderkey": {"type": "integer", "nullable": false}, "%s": {"type": "string"}, "note": {}}',
            F.lower("c_mktsegment"),
        ).alias("schema_definition"),
        F.format_string('{"max_age_hours": %d}', F.length("o_orderpriority")).alias("freshness"),
        F.format_string('{"min_row_count": %d}', "c_nationkey").alias("quality_rules"),
        F.col("o_orderkey").alias("seq"),
    )
    keys = ["pipeline", "dataset", "version", "schema_definition", "freshness", "quality_rules"]
    return rows.groupBy(*keys).agg(F.min("seq").alias("seq"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders dataset of every customer in credit, and one named by its segment."""
    customer = table(spark, sf_dir, "customer")
    base = customer.select(
        F.col("c_name").alias("pipeline"),
        F.lower("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") >= 0).alias("credit"),
        F.col("c_custkey").alias("seq"),
    )
    none = F.lit(None).cast("string").alias("location")
    orders = base.where("credit").select(
        "pipeline", F.lit("orders").alias("name"), F.lit("source").alias("role"), none, "seq"
    )
    named = base.select("pipeline", F.col("segment").alias("name"), F.lit("target").alias("role"), none, "seq")
    return orders.unionByName(named)


CTE = {
    "pipelines": """pipelines AS (
  SELECT c_name AS name, n_name AS owner, c_acctbal >= 0 AS enabled, c_custkey AS seq
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "runs": """runs0 AS (
  SELECT c_name AS pipeline, 'run-' || o_orderkey AS run_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'running' WHEN o_orderstatus = 'F' THEN 'failed'
         WHEN o_orderstatus = 'P' THEN 'late' ELSE 'passed' END AS status,
    c_custkey, c_acctbal, c_mktsegment, o_totalprice,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS contract_version,
    o_orderdate AS started_at, o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey),
runs AS (
  SELECT pipeline, run_id, status,
    CASE WHEN status <> 'running' THEN c_custkey END AS source_row_count,
    CASE WHEN status = 'passed' THEN CAST(floor(c_acctbal) AS BIGINT) END AS target_row_count,
    CASE WHEN status IN ('failed', 'late') THEN c_mktsegment END AS failure_reason,
    contract_version, started_at,
    CASE WHEN status <> 'running'
      THEN started_at + to_milliseconds(CAST(round(o_totalprice * 100) AS BIGINT) * 10) END AS ended_at,
    seq
  FROM runs0)""",
    "checks": """folded AS (
  SELECT l_orderkey, l_linenumber % 5 + 1 AS check_order, max(l_returnflag) AS flag, count(*) AS n,
    CAST(min(l_quantity) AS INTEGER) AS low, CAST(max(l_quantity) AS INTEGER) AS high
  FROM lineitem GROUP BY 1, 2),
checks AS (
  SELECT c_name AS pipeline, 'run-' || l_orderkey AS run_id, check_order,
    CASE check_order WHEN 1 THEN 'source_readability' WHEN 2 THEN 'schema_compatibility'
      WHEN 3 THEN 'target_schema_compatibility' WHEN 4 THEN 'row_count' ELSE 'freshness' END AS check_type,
    CASE flag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'passed' ELSE 'skipped' END AS status,
    '{"max_age_hours": ' || low || '}' AS expected,
    '{"age_hours": ' || high || ', "source_row_count": ' || n || '}' AS observed,
    'lines ' || n AS message,
    CASE flag WHEN 'R' THEN 'category-' || check_order END AS error_category, low, high, n
  FROM folded JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""",
    "incidents": """incidents AS (
  SELECT r.pipeline, r.run_id,
    CASE r.status WHEN 'failed' THEN 'contract_violation' ELSE 'late_arrival' END AS incident_type,
    CASE r.status WHEN 'failed' THEN 'medium' ELSE 'high' END AS severity,
    p.owner, CASE contract_version WHEN 5 THEN 'acknowledged' ELSE 'open' END AS status,
    true AS retryable, failure_reason AS failure_summary, ended_at AS first_observed_at
  FROM runs r JOIN pipelines p ON p.name = r.pipeline WHERE r.status IN ('failed', 'late'))""",
    "notifications": """notifications AS (
  SELECT CASE WHEN event_type <> 'view' THEN event_type END AS alert_name,
    CASE event_type WHEN 'view' THEN 'unknown' WHEN 'error' THEN 'firing' ELSE 'resolved' END AS status,
    CASE WHEN event_type = 'view' THEN props ELSE '{"status": "'
      || CASE event_type WHEN 'error' THEN 'firing' ELSE 'resolved' END
      || '", "alerts": [{"labels": {"alertname": "' || event_type || '"}}, {"labels": {}}]}' END AS payload,
    ts AS created_at, event_id AS seq
  FROM events)""",
    "contracts": """contracts AS (
  SELECT c_name AS pipeline, 'orders' AS dataset, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS version,
    '{"o_orderkey": {"type": "integer", "nullable": false}, "' || lower(c_mktsegment)
      || '": {"type": "string"}, "note": {}}' AS schema_definition,
    '{"max_age_hours": ' || length(o_orderpriority) || '}' AS freshness,
    '{"min_row_count": ' || c_nationkey || '}' AS quality_rules,
    lower(c_mktsegment) AS segment, length(o_orderpriority) AS hours, min(o_orderkey) AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
    "datasets": """datasets AS (
  SELECT c_name AS pipeline, 'orders' AS name, 'source' AS role, c_custkey AS seq
  FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT c_name, lower(c_mktsegment), 'target', c_custkey FROM customer)""",
    "latest": "latest AS (SELECT pipeline, max(seq) AS seq FROM runs GROUP BY pipeline)",
}

NEEDS = {"incidents": ["pipelines", "runs"], "latest": ["runs"]}


def sql(body: str, *names: str) -> str:
    """The query text with the derived tables it names in front."""
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    return "WITH " + ",\n".join(CTE[n] for n in ordered) + "\n" + body if ordered else body
