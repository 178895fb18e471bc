"""Run evaluation, registry, history, metrics, panels and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pactline import model
from pactline.functions.text import run_id
from pactline.functions.timestamps import moment_literal
from pactline.plans import admission, alerts, dashboards, history, metrics, registry, runs
from pactline.sources.contracts import explode_columns
from verification import tables as t
from verification.tables import sql

AS_OF = datetime(1998, 6, 15, 12)
EVENTS_AS_OF = datetime(2024, 1, 15, 6, 30)
DAY_AGO = "TIMESTAMP '1998-06-14 12:00:00'"

CASES = {}


def case(name, text=None):
    def keep(function):
        CASES[name] = (function, text)
        return function

    return keep


# -- run evaluation --------------------------------------------------------


@case(
    "run_verdicts",
    sql(
        """SELECT pipeline, run_id, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed_checks,
  CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'passed'
       WHEN count(*) FILTER (status = 'failed') = 1
        AND count(*) FILTER (status = 'failed' AND check_type = 'freshness') = 1 THEN 'late'
       ELSE 'failed' END AS status
FROM checks GROUP BY pipeline, run_id""",
        "checks",
    ),
)
def run_verdicts(spark, d):
    return runs.run_verdicts(t.checks(spark, d))


@case(
    "run_finalize",
    sql(
        """SELECT pipeline, run_id,
  CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'passed'
       WHEN count(*) FILTER (status = 'failed') = 1
        AND count(*) FILTER (status = 'failed' AND check_type = 'freshness') = 1 THEN 'late'
       ELSE 'failed' END AS status,
  string_agg(message, '; ' ORDER BY check_order) FILTER (status = 'failed') AS failure_reason,
  CAST(max(n) FILTER (check_type = 'row_count') AS BIGINT) AS source_row_count,
  CAST(NULL AS BIGINT) AS target_row_count,
  arg_min(error_category, check_order) FILTER (status = 'failed') AS error_category
FROM checks GROUP BY pipeline, run_id""",
        "checks",
    ),
)
def run_finalize(spark, d):
    return runs.finalize_runs(t.checks(spark, d))


@case(
    "run_short_circuit",
    sql(
        """SELECT pipeline, run_id, check_type, status FROM checks c
WHERE check_order = 1 OR NOT EXISTS (SELECT 1 FROM checks f WHERE f.pipeline = c.pipeline
  AND f.run_id = c.run_id AND f.check_order = 1 AND f.status = 'failed')""",
        "checks",
    ),
)
def run_short_circuit(spark, d):
    kept = runs.stop_at_unreadable(t.checks(spark, d))
    return kept.select("pipeline", "run_id", "check_type", "status")


@case(
    "incidents_derive",
    sql(
        """SELECT pipeline, run_id, incident_type, severity, owner, 'open' AS status, retryable,
  failure_summary, first_observed_at FROM incidents""",
        "incidents",
    ),
)
def incidents_derive(spark, d):
    return runs.derive_incidents(t.runs(spark, d), t.pipelines(spark, d))


@case(
    "run_health",
    sql(
        """SELECT r.pipeline, r.run_id, r.status, r.started_at, r.ended_at, r.source_row_count,
  r.target_row_count, r.failure_reason, r.contract_version,
  coalesce(c.checks, '') AS checks, coalesce(i.incidents, '') AS incidents
FROM runs r
LEFT JOIN (SELECT pipeline, run_id, string_agg(check_type || '=' || status || ':' || message, ','
  ORDER BY check_order) AS checks FROM checks GROUP BY 1, 2) c USING (pipeline, run_id)
LEFT JOIN (SELECT pipeline, run_id, string_agg(incident_type || '=' || severity || ':' || owner, ',') AS incidents
  FROM incidents GROUP BY 1, 2) i USING (pipeline, run_id)""",
        "checks",
        "incidents",
    ),
)
def run_health(spark, d):
    return flat_health(runs.health_summary(t.runs(spark, d), t.checks(spark, d), t.incidents(spark, d)))


def flat_health(found):
    """Health with its lists as texts."""

    def check(x):
        return F.concat(x["check_type"], F.lit("="), x["status"], F.lit(":"), x["message"])

    def incident(x):
        return F.concat(x["incident_type"], F.lit("="), x["severity"], F.lit(":"), x["owner"])

    return found.withColumn("checks", F.array_join(F.transform("checks", check), ",")).withColumn(
        "incidents", F.array_join(F.transform("incidents", incident), ",")
    )


def _offered(spark, d):
    """Submissions that share run ids: one per customer, priority and month."""
    return t.orders_by_customer(spark, d).select(
        F.col("c_name").alias("pipeline"),
        F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-"), "o_orderpriority").alias("run_id"),
        F.col("o_orderkey").alias("seq"),
        "o_orderstatus",
    )


OFFERED = """offered AS (SELECT c_name AS pipeline, strftime(o_orderdate, '%Y') || '-' || o_orderpriority AS run_id,
  o_orderkey AS seq, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)"""


@case(
    "run_idempotent",
    f"""WITH {OFFERED}
SELECT pipeline, run_id, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'stored' ELSE 'new' END AS origin,
  coalesce(min(seq) FILTER (o_orderstatus = 'F'), min(seq)) AS seq
FROM offered GROUP BY 1, 2""",
)
def run_idempotent(spark, d):
    offered = _offered(spark, d)
    return admission.first_submissions(offered, offered.where(F.col("o_orderstatus") == "F"))


@case(
    "run_new_submissions",
    f"""WITH {OFFERED}
SELECT pipeline, run_id, min(seq) AS seq FROM offered
GROUP BY 1, 2 HAVING count(*) FILTER (o_orderstatus = 'F') = 0""",
)
def run_new_submissions(spark, d):
    offered = _offered(spark, d)
    found = admission.new_submissions(offered, offered.where(F.col("o_orderstatus") == "F"))
    return found.select("pipeline", "run_id", "seq")


@case(
    "run_admission",
    sql(
        """SELECT r.pipeline, r.run_id, coalesce(n, 0) AS running, coalesce(n, 0) < 3 AS admitted,
  CASE WHEN n >= 3 THEN 'Concurrent run limit exceeded for ''' || r.pipeline || ''': ' || n || '/3' END
    AS reason
FROM runs r LEFT JOIN (SELECT pipeline, count(*) AS n FROM runs WHERE status = 'running' GROUP BY 1) c
  ON c.pipeline = r.pipeline""",
        "runs",
    ),
)
def run_admission(spark, d):
    stored = t.runs(spark, d)
    return admission.admit(stored.select("pipeline", "run_id"), stored)


@case(
    "run_validation",
    sql(
        """, subs AS (
  SELECT c_name AS pipeline, 'run-' || o_orderkey AS run_id,
    CASE WHEN o_totalprice > 400000 THEN 'unknown' ELSE 'orders' END AS dataset,
    CASE o_orderstatus WHEN 'F' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) WHEN 'O' THEN 6 END
      AS contract_version,
    CASE WHEN o_totalprice < 20000 THEN 'File not found: ' || o_orderkey END AS source_error,
    CASE WHEN o_totalprice > 480000 THEN 'File is empty' END AS target_error, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey),
newest AS (SELECT pipeline, max(version) AS v FROM contracts GROUP BY 1),
busy AS (SELECT pipeline, count(*) AS n FROM runs WHERE status = 'running' GROUP BY 1)
SELECT *, CASE WHEN reject_reason LIKE '%File not found%' THEN 'source_not_found'
    WHEN reject_reason LIKE '%File is empty' THEN 'source_not_readable'
    WHEN reject_reason LIKE 'Pipeline%' THEN 'unknown' WHEN stored THEN 'duplicate_run'
    WHEN reject_reason LIKE 'Concurrent%' THEN 'concurrent_limit_exceeded'
    WHEN reject_reason IS NOT NULL THEN 'unknown' END AS error_category FROM (
SELECT s.pipeline, s.run_id, s.dataset, s.o_orderdate < TIMESTAMP '1996-01-01' AS stored,
  coalesce(s.contract_version, CASE WHEN s.dataset = 'orders' THEN v END) AS effective_version,
  CASE WHEN source_error IS NOT NULL THEN 'Cannot resolve source: ' || source_error
    WHEN target_error IS NOT NULL THEN 'Cannot resolve target: ' || target_error
    WHEN p.enabled IS NULL THEN 'Pipeline ''' || s.pipeline || ''' not registered. Register it first.'
    WHEN s.o_orderdate < TIMESTAMP '1996-01-01' THEN NULL
    WHEN x.name IS NULL THEN 'Dataset ''' || s.dataset || ''' not found in pipeline ''' || s.pipeline || '''.'
    WHEN s.contract_version IS NOT NULL AND c.version IS NULL THEN
      'Contract version ' || s.contract_version || ' not found for dataset ''' || s.dataset || '''.'
    WHEN s.contract_version IS NULL AND (v IS NULL OR s.dataset <> 'orders') THEN
      'No contract found for dataset ''' || s.dataset || '''.'
    WHEN b.n >= 3 THEN 'Concurrent run limit exceeded for ''' || s.pipeline || ''': ' || b.n || '/3'
  END AS reject_reason
FROM subs s
LEFT JOIN (SELECT * FROM pipelines WHERE enabled) p ON p.name = s.pipeline
LEFT JOIN datasets x ON x.pipeline = s.pipeline AND x.name = s.dataset
LEFT JOIN newest n ON n.pipeline = s.pipeline
LEFT JOIN contracts c ON c.pipeline = s.pipeline AND c.dataset = s.dataset AND c.version = s.contract_version
LEFT JOIN busy b ON b.pipeline = s.pipeline)""",
        "pipelines",
        "runs",
        "contracts",
        "datasets",
    ),
)
def run_validation(spark, d):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    status = F.col("o_orderstatus")
    orders = t.orders_by_customer(spark, d)
    submissions = orders.select(
        F.col("c_name").alias("pipeline"),
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        F.when(price > 400000, "unknown").otherwise("orders").alias("dataset"),
        F.when(status == "F", F.substring("o_orderpriority", 1, 1).cast("int"))
        .when(status == "O", 6)
        .alias("contract_version"),
        F.when(price < 20000, F.format_string("File not found: %d", key)).alias("source_error"),
        F.when(price > 480000, "File is empty").alias("target_error"),
    )
    stored = t.runs(spark, d)
    earlier = stored.where(F.col("started_at") < moment_literal(datetime(1996, 1, 1)))
    # Runs of before 1996 are the stored ones; the running ones count for admission.
    known = earlier.unionByName(
        stored.where(F.col("status") == model.RUNNING)
        .where(F.col("started_at") >= moment_literal(datetime(1996, 1, 1)))
        .withColumn("run_id", F.concat(F.lit("other-"), "run_id"))
    )
    registered = t.pipelines(spark, d).where("enabled")
    return admission.validate(submissions, registered, t.datasets(spark, d), t.contracts(spark, d), known)


@case(
    "run_ids",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-' || substr(md5(c_name || o_orderkey), 1, 6) AS run_id
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def run_ids(spark, d):
    seed = F.concat("c_name", F.col("o_orderkey").cast("string"))
    return t.orders_by_customer(spark, d).select("o_orderkey", run_id(F.col("o_orderdate"), seed).alias("run_id"))


# -- registry --------------------------------------------------------------


@case(
    "registry_flows",
    """WITH existing AS (SELECT c_name AS name, c_mktsegment AS owner, c_custkey AS seq FROM customer
  WHERE c_acctbal < 0),
offered AS (SELECT c_name AS name, o_orderpriority AS owner, o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT * FROM existing UNION ALL
SELECT name, arg_min(owner, seq), min(seq) FROM offered WHERE name NOT IN (SELECT name FROM existing) GROUP BY name""",
)
def registry_flows(spark, d):
    existing = t.table(spark, d, "customer").where("c_acctbal < 0").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("owner"), F.col("c_custkey").alias("seq")
    )
    offered = t.orders_by_customer(spark, d).select(
        F.col("c_name").alias("name"), F.col("o_orderpriority").alias("owner"), F.col("o_orderkey").alias("seq")
    )
    return registry.get_or_create(existing, offered, registry.PIPELINE_KEY)


@case(
    "registry_datasets",
    sql(
        """, offered AS (SELECT c_name AS pipeline, 'orders' AS name, o_orderpriority AS role, o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT pipeline, name, role, seq FROM datasets UNION ALL
SELECT pipeline, name, arg_min(role, seq), min(seq) FROM offered o
WHERE NOT EXISTS (SELECT 1 FROM datasets x WHERE x.pipeline = o.pipeline AND x.name = o.name)
GROUP BY pipeline, name""",
        "datasets",
    ),
)
def registry_datasets(spark, d):
    offered = t.orders_by_customer(spark, d).select(
        F.col("c_name").alias("pipeline"),
        F.lit("orders").alias("name"),
        F.col("o_orderpriority").alias("role"),
        F.col("o_orderkey").alias("seq"),
    )
    existing = t.datasets(spark, d).drop("location")
    return registry.get_or_create(existing, offered, registry.DATASET_KEY)


@case(
    "registry_contracts",
    """WITH offered AS (SELECT c_name AS pipeline, o_orderstatus AS dataset,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS version,
  '{"max_age_hours": ' || CAST(floor(o_totalprice) AS BIGINT) || '}' AS freshness, o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT pipeline, dataset, version, arg_min(freshness, seq) AS freshness, min(seq) AS seq
FROM offered GROUP BY 1, 2, 3""",
)
def registry_contracts(spark, d):
    offered = t.orders_by_customer(spark, d).select(
        F.col("c_name").alias("pipeline"),
        F.col("o_orderstatus").alias("dataset"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("version"),
        F.format_string('{"max_age_hours": %d}', F.floor("o_totalprice").cast("bigint")).alias("freshness"),
        F.col("o_orderkey").alias("seq"),
    )
    return registry.first_written(offered, registry.CONTRACT_KEY)


@case(
    "registry_flow_by_name",
    sql("SELECT name, owner, enabled FROM pipelines WHERE name = 'Customer#000000007'", "pipelines"),
)
def registry_flow_by_name(spark, d):
    return registry.pipeline_by_name(t.pipelines(spark, d), "Customer#000000007").drop("seq")


@case(
    "registry_dataset_by_name",
    sql("SELECT pipeline, name, role, seq FROM datasets WHERE name = 'orders' ORDER BY seq LIMIT 1", "datasets"),
)
def registry_dataset_by_name(spark, d):
    return registry.dataset_by_name(t.datasets(spark, d), "orders").drop("location")


@case(
    "registry_first_datasets",
    sql(
        """SELECT arg_min(pipeline, seq) AS pipeline, name, arg_min(role, seq) AS role, min(seq) AS seq
FROM datasets GROUP BY name""",
        "datasets",
    ),
)
def registry_first_datasets(spark, d):
    return registry.first_datasets(t.datasets(spark, d)).drop("location")


CONTRACT_COLUMNS = ["pipeline", "dataset", "version", "schema_definition", "freshness", "quality_rules"]


@case(
    "contract_latest",
    sql(
        f"""SELECT {', '.join(CONTRACT_COLUMNS)} FROM contracts
QUALIFY row_number() OVER (PARTITION BY pipeline, dataset ORDER BY version DESC) = 1""",
        "contracts",
    ),
)
def contract_latest(spark, d):
    return registry.latest_contracts(t.contracts(spark, d)).select(*CONTRACT_COLUMNS)


@case(
    "contract_by_version",
    sql(
        f"""SELECT {', '.join(CONTRACT_COLUMNS)} FROM contracts
WHERE pipeline = 'Customer#000000000' AND dataset = 'orders' AND version = 1""",
        "contracts",
    ),
)
def contract_by_version(spark, d):
    found = registry.contract_by_version(t.contracts(spark, d), "Customer#000000000", "orders", 1)
    return found.select(*CONTRACT_COLUMNS)


@case(
    "contract_columns",
    sql(
        """SELECT pipeline, dataset, version, 0 AS position, 'o_orderkey' AS column, 'integer' AS type, false AS nullable
FROM contracts UNION ALL
SELECT pipeline, dataset, version, 1, segment, 'string', true FROM contracts UNION ALL
SELECT pipeline, dataset, version, 2, 'note', 'string', true FROM contracts""",
        "contracts",
    ),
)
def contract_columns(spark, d):
    return explode_columns(t.contracts(spark, d))


@case(
    "contract_summary",
    sql(
        """SELECT c.pipeline, c.dataset AS dataset_name, x.role, max(c.version) AS contract_version,
  'o_orderkey,' || any_value(c.segment) || ',note' AS schema_columns,
  CAST(arg_max(c.hours, c.version) AS DOUBLE) AS freshness_max_age_hours,
  arg_max(c.quality_rules, c.version) AS quality_rules
FROM contracts c JOIN datasets x ON x.pipeline = c.pipeline AND x.name = c.dataset GROUP BY 1, 2, 3""",
        "contracts",
        "datasets",
    ),
)
def contract_summary(spark, d):
    found = registry.contract_summaries(t.contracts(spark, d), t.datasets(spark, d))
    return found.withColumn("schema_columns", F.array_join("schema_columns", ","))


# -- history ---------------------------------------------------------------

RUN_COLUMNS = ["pipeline", "run_id", "status", "started_at", "ended_at", "seq"]


@case(
    "latest_run_started",
    sql(
        f"""SELECT {', '.join(RUN_COLUMNS)} FROM runs
QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, seq DESC) = 1""",
        "runs",
    ),
)
def latest_run_started(spark, d):
    return history.latest_runs(t.runs(spark, d)).select(*RUN_COLUMNS)


@case(
    "latest_run_seq",
    sql(f"SELECT {', '.join(RUN_COLUMNS)} FROM runs SEMI JOIN latest USING (pipeline, seq)", "runs", "latest"),
)
def latest_run_seq(spark, d):
    return history.latest_runs(t.runs(spark, d), by="seq").select(*RUN_COLUMNS)


RUN_ITEM_SQL = """pipeline, run_id, status, started_at, ended_at,
  (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS duration_ms, source_row_count, target_row_count,
  failure_reason, contract_version"""


@case(
    "run_page",
    sql(
        f"""SELECT {RUN_ITEM_SQL} FROM runs WHERE status = 'late'
QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, seq DESC) BETWEEN 2 AND 3""",
        "runs",
    ),
)
def run_page(spark, d):
    return history.list_runs(t.runs(spark, d), status=model.LATE, limit=2, offset=1)


@case(
    "run_page_deep",
    sql(
        f"""SELECT {RUN_ITEM_SQL} FROM (SELECT * REPLACE (CASE WHEN seq % 16 = 0 THEN 'small' ELSE 'large' END AS pipeline) FROM runs)
QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, seq DESC) BETWEEN 1001 AND 1040""",
        "runs",
    ),
)
def run_page_deep(spark, d):
    """A page far back of two pipelines, one of which owns most runs."""
    shared = F.when(F.col("seq") % 16 == 0, "small").otherwise("large")
    return history.list_runs(t.runs(spark, d).withColumn("pipeline", shared), limit=40, offset=1000)


@case(
    "run_page_of_one",
    sql(
        f"""SELECT {RUN_ITEM_SQL} FROM runs WHERE pipeline = 'Customer#000000007'
ORDER BY started_at DESC, seq DESC LIMIT 5 OFFSET 2""",
        "runs",
    ),
)
def run_page_of_one(spark, d):
    return history.list_runs(t.runs(spark, d), "Customer#000000007", limit=5, offset=2)


@case(
    "run_first_by_id",
    f"""WITH {OFFERED}
SELECT run_id, arg_min(pipeline, seq) AS pipeline, min(seq) AS seq FROM offered GROUP BY run_id""",
)
def run_first_by_id(spark, d):
    return history.first_runs(_offered(spark, d))


@case(
    "run_lookup",
    sql(f"SELECT {', '.join(RUN_COLUMNS)} FROM runs WHERE run_id = 'run-77'", "runs"),
)
def run_lookup(spark, d):
    return history.find_run(t.runs(spark, d), "run-77").select(*RUN_COLUMNS)


@case(
    "run_checks_of_failed",
    sql(
        """SELECT pipeline, run_id, check_type, status, message FROM checks
SEMI JOIN (SELECT * FROM runs WHERE status = 'failed') f USING (pipeline, run_id)""",
        "checks",
        "runs",
    ),
)
def run_checks_of_failed(spark, d):
    failed = t.runs(spark, d).where(F.col("status") == model.FAILED)
    found = history.of_runs(t.checks(spark, d), failed)
    return found.select("pipeline", "run_id", "check_type", "status", "message")


@case(
    "run_incidents_of_latest",
    sql(
        """, last AS (SELECT pipeline, run_id FROM runs SEMI JOIN latest USING (pipeline, seq))
SELECT * FROM incidents SEMI JOIN last USING (pipeline, run_id)""",
        "incidents",
        "latest",
    ),
)
def run_incidents_of_latest(spark, d):
    return history.of_runs(t.incidents(spark, d), history.latest_runs(t.runs(spark, d), by="seq"))


@case(
    "run_latest_health",
    sql(
        """, last AS (SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, seq DESC) = 1)
SELECT r.pipeline, r.run_id, r.status, r.failure_reason, coalesce(c.n, 0) AS checks, coalesce(i.n, 0) AS incidents
FROM last r
LEFT JOIN (SELECT pipeline, run_id, count(*)::INTEGER AS n FROM checks GROUP BY 1, 2) c USING (pipeline, run_id)
LEFT JOIN (SELECT pipeline, run_id, count(*)::INTEGER AS n FROM incidents GROUP BY 1, 2) i USING (pipeline, run_id)""",
        "checks",
        "incidents",
    ),
)
def run_latest_health(spark, d):
    found = history.latest_health(t.runs(spark, d), t.checks(spark, d), t.incidents(spark, d))
    return found.select(
        "pipeline",
        "run_id",
        "status",
        "failure_reason",
        F.size("checks").alias("checks"),
        F.size("incidents").alias("incidents"),
    )


@case(
    "incidents_open_topk",
    sql(
        """SELECT * FROM incidents WHERE status = 'open'
QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY first_observed_at DESC, run_id DESC) <= 2""",
        "incidents",
    ),
)
def incidents_open_topk(spark, d):
    return history.open_incidents(t.incidents(spark, d), t.runs(spark, d), limit=2)


@case(
    "incidents_acknowledge",
    sql(
        """SELECT i.* REPLACE (CASE WHEN r.status = 'late' AND i.status = 'open' THEN 'acknowledged'
  ELSE i.status END AS status) FROM incidents i JOIN runs r USING (pipeline, run_id)""",
        "incidents",
    ),
)
def incidents_acknowledge(spark, d):
    late = t.runs(spark, d).where(F.col("status") == model.LATE)
    return history.acknowledge(t.incidents(spark, d), late)


@case(
    "incidents_acknowledged_counts",
    sql(
        """SELECT r.pipeline, r.run_id, CAST(count(i.run_id) AS BIGINT) AS acknowledged FROM runs r
LEFT JOIN (SELECT * FROM incidents WHERE status = 'open') i USING (pipeline, run_id) GROUP BY 1, 2""",
        "incidents",
    ),
)
def incidents_acknowledged_counts(spark, d):
    return history.acknowledged_counts(t.incidents(spark, d), t.runs(spark, d))


@case(
    "alert_log",
    sql("SELECT * FROM notifications ORDER BY created_at DESC, seq DESC LIMIT 1000", "notifications"),
)
def alert_log(spark, d):
    return history.notification_log(t.notifications(spark, d), 1000)


# -- metrics ---------------------------------------------------------------


@case("metrics_flows", sql("SELECT count(*) AS total, count(*) FILTER (enabled) AS active FROM pipelines", "pipelines"))
def metrics_flows(spark, d):
    return metrics.pipeline_counts(t.pipelines(spark, d))


@case(
    "metrics_run_status",
    sql(f"SELECT status, count(*) AS runs FROM runs WHERE started_at >= {DAY_AGO} GROUP BY status", "runs"),
)
def metrics_run_status(spark, d):
    return metrics.run_status_counts(t.runs(spark, d), AS_OF)


RUN_METRICS_SQL = f"""SELECT count(*) FILTER (started_at >= {DAY_AGO}) AS total,
  count(*) FILTER (started_at >= {DAY_AGO} AND status = 'passed') AS passed,
  count(*) FILTER (started_at >= {DAY_AGO} AND status = 'late') AS late,
  CAST((sum(epoch_us(ended_at) - epoch_us(started_at)) FILTER (started_at >= {DAY_AGO}))
    // (count(ended_at) FILTER (started_at >= {DAY_AGO}) * 1000) AS BIGINT) AS avg_duration_ms,
  count(*) FILTER (ended_at IS NULL AND started_at < TIMESTAMP '1998-06-15 11:00:00') AS stuck
FROM runs"""


@case("metrics_runs", sql(RUN_METRICS_SQL, "runs"))
def metrics_runs(spark, d):
    return metrics.run_metrics(t.runs(spark, d), AS_OF).select(
        "total",
        F.col("by_status")["passed"].alias("passed"),
        F.col("by_status")["late"].alias("late"),
        "avg_duration_ms",
        "stuck",
    )


FAILED_CHECKS_SQL = f"""SELECT c.check_type, CAST(count(*) AS BIGINT) AS failed
FROM checks c JOIN runs r USING (pipeline, run_id)
WHERE c.status = 'failed' AND r.started_at >= {DAY_AGO} GROUP BY 1"""


@case("metrics_failed_checks", sql(FAILED_CHECKS_SQL, "checks", "runs"))
def metrics_failed_checks(spark, d):
    return metrics.failed_check_counts(t.checks(spark, d), t.runs(spark, d), AS_OF)


@case("metrics_open_incidents", sql("SELECT count(*) AS open FROM incidents WHERE status = 'open'", "incidents"))
def metrics_open_incidents(spark, d):
    return metrics.open_incident_count(t.incidents(spark, d))


@case(
    "metrics_alerts",
    sql(
        """SELECT status, count(*) AS notifications FROM notifications
WHERE created_at >= TIMESTAMP '2024-01-14 06:30:00' GROUP BY status""",
        "notifications",
    ),
)
def metrics_alerts(spark, d):
    return metrics.notification_counts(t.notifications(spark, d), EVENTS_AS_OF)


@case(
    "metrics_document",
    sql(
        f""", rm AS ({RUN_METRICS_SQL}), fc AS ({FAILED_CHECKS_SQL})
SELECT '1998-06-15T12:00:00' AS timestamp, (SELECT count(*) FROM pipelines) AS flows,
  (SELECT count(*) FROM pipelines WHERE enabled) AS active, rm.*,
  (SELECT CAST(sum(failed) AS BIGINT) FROM fc) AS failed_checks,
  (SELECT failed FROM fc WHERE check_type = 'row_count') AS failed_row_count,
  (SELECT count(*) FROM incidents WHERE status = 'open') AS open,
  (SELECT count(*) FROM notifications) AS alerts,
  (SELECT count(*) FROM notifications WHERE status = 'firing') AS firing
FROM rm""",
        "checks",
        "incidents",
        "notifications",
    ),
)
def metrics_document(spark, d):
    document = metrics.operational_metrics(
        t.pipelines(spark, d),
        t.runs(spark, d),
        t.checks(spark, d),
        t.incidents(spark, d),
        t.notifications(spark, d),
        AS_OF,
    )
    return document.select(
        "timestamp",
        F.col("pipelines.total").alias("flows"),
        "pipelines.active",
        "runs_24h.total",
        F.col("runs_24h.by_status")["passed"].alias("passed"),
        F.col("runs_24h.by_status")["late"].alias("late"),
        "runs_24h.avg_duration_ms",
        "runs_24h.stuck",
        F.col("checks_24h.total_failed").alias("failed_checks"),
        F.col("checks_24h.failed_by_type")["row_count"].alias("failed_row_count"),
        "incidents.open",
        F.col("notifications_24h.total").alias("alerts"),
        F.col("notifications_24h.by_status")["firing"].alias("firing"),
    )


# -- panels ----------------------------------------------------------------


@case(
    "panel_latest_status",
    sql(
        """SELECT r.pipeline, r.run_id, r.status, r.started_at, r.ended_at,
  CAST(round((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0) AS BIGINT) AS duration_seconds,
  r.source_row_count, r.target_row_count, r.failure_reason
FROM runs r JOIN pipelines p ON p.name = r.pipeline SEMI JOIN latest l ON l.pipeline = r.pipeline AND l.seq = r.seq""",
        "pipelines",
        "runs",
        "latest",
    ),
)
def panel_latest_status(spark, d):
    return dashboards.latest_status(t.runs(spark, d), t.pipelines(spark, d))


@case(
    "panel_run_history",
    sql(
        """SELECT r.started_at AS time, r.pipeline,
  CASE r.status WHEN 'passed' THEN 0 WHEN 'late' THEN 1 ELSE 2 END AS status_code, r.status
FROM runs r JOIN pipelines p ON p.name = r.pipeline WHERE r.ended_at IS NOT NULL""",
        "pipelines",
        "runs",
    ),
)
def panel_run_history(spark, d):
    return dashboards.run_history(t.runs(spark, d), t.pipelines(spark, d))


@case(
    "panel_hours_since_end",
    sql(
        """SELECT r.pipeline, (epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(r.ended_at)) / 3600000000.0 AS age_hours
FROM runs r JOIN pipelines p ON p.name = r.pipeline SEMI JOIN latest l ON l.pipeline = r.pipeline AND l.seq = r.seq""",
        "pipelines",
        "runs",
        "latest",
    ),
)
def panel_hours_since_end(spark, d):
    return dashboards.hours_since_end(t.runs(spark, d), t.pipelines(spark, d), datetime(2002, 1, 1))


@case(
    "panel_row_counts",
    sql(
        """SELECT r.pipeline, r.source_row_count AS source, r.target_row_count AS target
FROM runs r JOIN pipelines p ON p.name = r.pipeline SEMI JOIN latest l ON l.pipeline = r.pipeline AND l.seq = r.seq""",
        "pipelines",
        "runs",
        "latest",
    ),
)
def panel_row_counts(spark, d):
    return dashboards.row_counts(t.runs(spark, d), t.pipelines(spark, d))


@case(
    "panel_failed_checks",
    sql(
        "SELECT check_type AS metric, count(*) AS value FROM checks WHERE status = 'failed' GROUP BY 1", "checks"
    ),
)
def panel_failed_checks(spark, d):
    return dashboards.failed_checks(t.checks(spark, d))


@case(
    "panel_open_incidents",
    sql(
        """SELECT i.pipeline, i.run_id, i.incident_type, i.severity, i.owner, i.retryable, i.failure_summary,
  i.first_observed_at
FROM incidents i JOIN runs r USING (pipeline, run_id) JOIN pipelines p ON p.name = i.pipeline
WHERE i.status = 'open'""",
        "incidents",
    ),
)
def panel_open_incidents(spark, d):
    return dashboards.all_open_incidents(t.incidents(spark, d), t.runs(spark, d), t.pipelines(spark, d))


@case(
    "panel_schema_drift",
    sql(
        """SELECT c.pipeline, c.run_id, c.check_type, c.message, c.expected, c.observed, r.started_at
FROM checks c JOIN runs r USING (pipeline, run_id) JOIN pipelines p ON p.name = c.pipeline
WHERE c.check_type IN ('schema_compatibility', 'target_schema_compatibility') AND c.status = 'failed'
ORDER BY r.started_at DESC, r.seq DESC, c.check_type LIMIT 50""",
        "checks",
        "pipelines",
        "runs",
    ),
)
def panel_schema_drift(spark, d):
    return dashboards.recent_schema_drift(t.checks(spark, d), t.runs(spark, d), t.pipelines(spark, d))


# -- alerts ----------------------------------------------------------------

ALERT_SQL = {
    "failed_run": """SELECT r.pipeline, r.run_id, r.status, r.failure_reason, r.ended_at AS time
FROM runs r JOIN pipelines p ON p.name = r.pipeline SEMI JOIN latest l ON l.pipeline = r.pipeline AND l.seq = r.seq
WHERE r.status = 'failed'""",
    "stale_data": """SELECT c.pipeline, CAST(c.high AS DOUBLE) AS age_hours, CAST(c.low AS DOUBLE) AS threshold_hours,
  r.started_at AS time
FROM checks c JOIN runs r USING (pipeline, run_id) JOIN pipelines p ON p.name = c.pipeline
SEMI JOIN latest l ON l.pipeline = r.pipeline AND l.seq = r.seq
WHERE c.check_type = 'freshness' AND c.status = 'failed' AND c.high > c.low""",
    "open_incidents": """SELECT i.pipeline, i.severity, i.owner, i.failure_summary, i.first_observed_at AS time
FROM incidents i JOIN runs r USING (pipeline, run_id) JOIN pipelines p ON p.name = i.pipeline
WHERE i.status = 'open'""",
    "schema_drift": """SELECT c.pipeline, c.check_type, c.message, c.expected, c.observed, r.started_at AS time
FROM checks c JOIN runs r USING (pipeline, run_id) JOIN pipelines p ON p.name = c.pipeline
SEMI JOIN latest l ON l.pipeline = r.pipeline AND l.seq = r.seq
WHERE c.check_type IN ('schema_compatibility', 'target_schema_compatibility') AND c.status = 'failed'""",
}
ALERT_TABLES = ("checks", "incidents", "latest")


def _rules(spark, d):
    return alerts.rule_rows(
        t.pipelines(spark, d), t.runs(spark, d), t.checks(spark, d), t.incidents(spark, d)
    )


for _name, _text in ALERT_SQL.items():
    CASES[f"alert_{_name}"] = (
        lambda spark, d, _name=_name: _rules(spark, d)[_name],
        sql(_text, *ALERT_TABLES),
    )

_FIRING = " UNION ALL ".join(
    f"SELECT '{uid}' AS rule, '{title}' AS title, '{severity}' AS severity, '{owner}' AS owner, "
    f"'{category}' AS category, count(*) AS value, count(*) > 0 AS firing FROM ({ALERT_SQL[name]}) q"
    for name, (uid, title, severity, owner, category) in alerts.RULES.items()
)


@case("alerts_firing", sql(_FIRING, *ALERT_TABLES))
def alerts_firing(spark, d):
    """All rules in one fold of the three tables."""
    return alerts.states(t.pipelines(spark, d), t.runs(spark, d), t.checks(spark, d), t.incidents(spark, d))


@case("alert_ingest", sql("SELECT * FROM notifications", "notifications"))
def alert_ingest(spark, d):
    return t.notifications(spark, d)


@case(
    "alert_records",
    sql(
        """SELECT r.pipeline, r.run_id, r.status, '2002-01-01T00:00:00+00:00' AS sent, i.owner, 'true' AS retryable,
  (SELECT count(*) FROM checks c WHERE c.pipeline = r.pipeline AND c.run_id = r.run_id AND c.status = 'failed')
    ::INTEGER AS failures,
  (SELECT arg_min(check_type, check_order) FROM checks c WHERE c.pipeline = r.pipeline AND c.run_id = r.run_id
    AND c.status = 'failed') AS first_failure,
  'http://localhost:8000/pipelines/' || r.pipeline || '/runs/' || r.run_id AS link
FROM runs r JOIN incidents i USING (pipeline, run_id)""",
        "checks",
        "incidents",
    ),
)
def alert_records(spark, d):
    sent = moment_literal(datetime(2002, 1, 1))
    found = alerts.alert_records(t.runs(spark, d), t.checks(spark, d), t.incidents(spark, d), sent)

    def at(path):
        return F.get_json_object("payload", path)

    return found.select(
        "pipeline",
        "run_id",
        at("$.status").alias("status"),
        at("$.timestamp").alias("sent"),
        at("$.incident.owner").alias("owner"),
        at("$.incident.retryable").alias("retryable"),
        F.coalesce(F.json_array_length(at("$.failed_checks")), F.lit(0)).alias("failures"),
        at("$.failed_checks[0].type").alias("first_failure"),
        at("$.links.run").alias("link"),
    )
