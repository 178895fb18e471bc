"""Sources, sinks and streams: tables are written to the shared folder and read back."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline import model
from pactline.operators.checks import check_freshness, check_readability, check_row_count, check_schema, contract_checks
from pactline.plans import history, registry
from pactline.session import work_folder
from pactline.sources.contracts import ColumnRule, Contract, explode_columns, read_contract_files
from pactline.sources.resolve import profile, resolve
from pactline.sources.store import ControlStore
from pactline.streaming import count_distinct_keys, count_rows, stream_rows, unique_key_totals, watch_alerts
from pactline.streaming.counters import row_total
from verification import cases_control as control
from verification import tables as t
from verification.tables import sql

CASES = {}


def case(name, text=None):
    def keep(function):
        CASES[name] = (function, text)
        return function

    return keep


def _bare(path):
    return path.removeprefix("file:")


# -- sources ---------------------------------------------------------------


@case("source_parquet", "SELECT * FROM orders")
def source_parquet(spark, d):
    return resolve(spark, f"{d}/orders.parquet").frame


@case(
    "source_text",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
)
def source_text(spark, d):
    """Texts with quotes and line breaks through delimited files."""
    folder = _bare(work_folder(spark, "text"))
    rows = t.table(spark, d, "documents")
    rows.write.option("header", "true").option("escape", '"').csv(folder)
    return resolve(spark, f"partition://{folder}").frame


@case("source_object_store", "SELECT * FROM customer")
def source_object_store(spark, d):
    folder = work_folder(spark, "bucket")
    t.table(spark, d, "customer").write.parquet(f"{folder}/lake/customer.parquet")
    return resolve(spark, "s3://lake/customer.parquet", object_store=f"{folder}/").frame


@case(
    "source_object_text",
    "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ', \"' || c_mktsegment || '\"' AS name FROM customer",
)
def source_object_text(spark, d):
    """A delimited file in an object store, with quoted commas; one writer makes one file."""
    folder = work_folder(spark, "bucket")
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name")
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), name).coalesce(1)
    rows.write.option("header", "true").option("escape", '"').csv(f"{folder}/lake/customers")
    file = spark.read.text(f"{folder}/lake/customers").select("_metadata.file_name").first()[0]
    return resolve(spark, f"s3://lake/customers/{file}", object_store=f"{folder}/").frame


@case("source_catalog_table", "SELECT * FROM part")
def source_catalog_table(spark, d):
    t.table(spark, d, "part").createOrReplaceTempView("checked_part")
    return resolve(spark, "table://checked_part").frame


@case(
    "source_query",
    "SELECT n_regionkey, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
)
def source_query(spark, d):
    for name in ("supplier", "nation"):
        t.table(spark, d, name).createOrReplaceTempView(f"checked_{name}")
    text = (
        "SELECT n_regionkey, count(*) AS suppliers FROM checked_supplier "
        "JOIN checked_nation ON s_nationkey = n_nationkey GROUP BY n_regionkey"
    )
    return resolve(spark, f"query://{text}").frame


def _partitioned(spark, d):
    folder = _bare(work_folder(spark, "partitions"))
    t.table(spark, d, "orders").write.partitionBy("o_orderstatus").parquet(folder)
    return folder


@case("source_partitions", "SELECT * FROM orders")
def source_partitions(spark, d):
    return resolve(spark, f"partition://{_partitioned(spark, d)}").frame


@case("source_one_partition", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def source_one_partition(spark, d):
    return resolve(spark, f"partition://{_partitioned(spark, d)}/o_orderstatus=F").frame


@case(
    "source_partitions_checked",
    """SELECT check_type, message FROM (SELECT 1 AS o, 'source_readability' AS check_type,
  'Source readable: ' || count(*) || ' rows, 5 columns' AS message FROM orders
  UNION ALL SELECT 2, 'schema_compatibility', 'Schema matches: 5 columns as expected'
  UNION ALL SELECT 3, 'target_schema_compatibility', 'No target to validate'
  UNION ALL SELECT 4, 'row_count', 'Row count ' || count(*) || ' within range [0, inf]' FROM orders
  UNION ALL SELECT 5, 'freshness', 'Data is stale: ' || round((epoch_us(TIMESTAMP '2002-01-01 00:00:00')
    - epoch_us(max(o_orderdate))) / 3600000000.0, 2) || 'h old (max 24h)' FROM orders)""",
)
def source_partitions_checked(spark, d):
    """Partition folders are no columns of the data unless the contract names them."""
    source = resolve(spark, f"partition://{_partitioned(spark, d)}")
    rules = {
        "o_orderkey": "integer",
        "o_custkey": "integer",
        "o_totalprice": "decimal",
        "o_orderdate": "date",
        "o_orderpriority": "string",
    }
    contract = Contract(
        tuple(ColumnRule(n, k, False) for n, k in rules.items()),
        timestamp_column="o_orderdate",
        unique_keys=("o_orderkey",),
    )
    return contract_checks(source, contract, datetime(2002, 1, 1)).select("check_type", "message")


@case(
    "source_profile",
    """SELECT count(*) AS row_count, 6 AS column_count, 'event_id,ts,user_id,event_type,value,props' AS columns
FROM events""",
)
def source_profile(spark, d):
    found = profile(resolve(spark, f"local://{d}/events.parquet"))
    return found.select("row_count", "column_count", F.array_join("columns", ",").alias("columns"))


@case(
    "source_text_file",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', "' || p_brand || '"' AS name FROM part
UNION ALL SELECT '  ', NULL FROM part WHERE p_partkey % 7 = 0""",
)
def source_text_file(spark, d):
    """One text file with empty lines, lines of blanks and quoted commas; one writer makes one file."""
    folder = _bare(work_folder(spark, "file"))
    part = t.table(spark, d, "part")
    line = F.concat(F.col("p_partkey"), F.lit(',"'), F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('"""'))
    odd = F.when(F.col("p_partkey") % 7 == 0, F.array(line, F.lit("  "), F.lit(""))).otherwise(F.array(line))
    lines = part.select(F.lit(1).alias("place"), F.explode(odd).alias("value"))
    header = spark.range(1).select(F.lit(0).alias("place"), F.lit("id,name").alias("value"))
    header.unionByName(lines).coalesce(1).sortWithinPartitions("place").select("value").write.text(folder)
    file = spark.read.text(folder).select("_metadata.file_path").first()[0]
    return resolve(spark, _bare(file)).frame


@case(
    "source_text_header_breaks",
    "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment || chr(10) || 'end' AS segment FROM customer",
)
def source_text_header_breaks(spark, d):
    """Text whose column names, and some values, have line breaks."""
    folder = _bare(work_folder(spark, "breaks"))
    rows = t.table(spark, d, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit("\nend")))
    rows.toDF("customer\nkey", "name", "market\n\nsegment").write.option("header", "true").option("escape", '"').csv(folder)
    found = resolve(spark, f"partition://{folder}").frame
    return found.select(F.col("customer\nkey").alias("key"), "name", F.col("market\n\nsegment").alias("segment"))


@case(
    "source_text_headers",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name,
  CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment, CAST(c_custkey % 3 AS INTEGER) AS part FROM customer""",
)
def source_text_headers(spark, d):
    """Partitions of text whose columns differ in order and number."""
    folder = _bare(work_folder(spark, "headers"))
    rows = t.table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    for part, columns in enumerate((["key", "name"], ["segment", "name", "key"], ["segment", "key"])):
        chosen = rows.where(F.col("key") % 3 == part).select(*columns)
        chosen.write.option("header", "true").csv(f"{folder}/part={part}")
    return resolve(spark, f"partition://{folder}").frame.select("key", "name", "segment", "part")


def _drifting(spark, d):
    folder = _bare(work_folder(spark, "drift"))
    orders = t.table(spark, d, "orders").withColumn("extra", F.col("o_custkey"))
    base = ["o_orderkey", "o_orderpriority"]
    for status, columns in {"F": base, "O": [*base, "extra"], "P": base[:1]}.items():
        orders.where(F.col("o_orderstatus") == status).select(*columns).write.parquet(f"{folder}/o_orderstatus={status}")
    return folder


@case(
    "source_partitions_drift",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS extra, o_orderstatus FROM orders""",
)
def source_partitions_drift(spark, d):
    """Partitions with a column more or less than others."""
    found = resolve(spark, f"partition://{_drifting(spark, d)}").frame
    return found.select("o_orderkey", "o_orderpriority", "extra", "o_orderstatus")


@case(
    "check_partitions_drift",
    """SELECT 'failed' AS status, 'Unexpected columns: [''extra'']; Null violations ('
  || count(*) FILTER (o_orderstatus = 'P') || '): Null in non-nullable column ''o_orderpriority''' AS message FROM orders""",
)
def check_partitions_drift(spark, d):
    """The schema check names a column that some partitions have, and counts what others lack."""
    source = resolve(spark, f"partition://{_drifting(spark, d)}")
    contract = Contract((ColumnRule("o_orderkey", "integer", False), ColumnRule("o_orderpriority", "string", False)))
    return check_schema(source, contract).select("status", "message")


@case(
    "checks_unreadable",
    """SELECT v.* FROM (SELECT count(*) AS n FROM customer), LATERAL (VALUES
  ('good', 'source_readability', 'passed', 'Source readable: ' || n || ' rows, 2 columns'),
  ('bad', 'source_readability', 'failed', 'Source not readable: Failed to read partitions: text is not valid UTF-8'),
  ('bad', 'schema_compatibility', 'failed',
    'Cannot read source for schema check: Failed to read partitions: text is not valid UTF-8'),
  ('bad', 'row_count', 'failed', 'Cannot read source for row count: Failed to read partitions: text is not valid UTF-8'),
  ('bad', 'freshness', 'failed', 'Cannot read source for freshness: Failed to read partitions: text is not valid UTF-8')
) v(source, check_type, status, message)""",
)
def checks_unreadable(spark, d):
    """A folder in which the rows of one nation are in another encoding, and the same rows in the right one."""
    folder = _bare(work_folder(spark, "encodings"))
    name = F.concat("c_name", F.lit(" é")).alias("name")
    rows = t.table(spark, d, "customer").select("c_custkey", name, "c_nationkey")
    rows.drop("c_nationkey").write.option("header", "true").csv(f"{folder}/good")
    for damaged, encoding in ((F.col("c_nationkey") == 3, "ISO-8859-1"), (F.col("c_nationkey") != 3, "UTF-8")):
        chosen = rows.where(damaged).drop("c_nationkey").write.mode("append").option("header", "true")
        chosen.option("encoding", encoding).csv(f"{folder}/bad")
    contract = Contract((ColumnRule("c_custkey", "integer"),))
    good, bad = (resolve(spark, f"partition://{folder}/{x}") for x in ("good", "bad"))
    results = [("good", check_readability(good)), ("bad", check_readability(bad)), ("bad", check_schema(bad, contract))]
    results += [("bad", check_row_count(bad, contract)), ("bad", check_freshness(bad, contract, datetime(2002, 1, 1)))]
    named = [f.select(F.lit(n).alias("source"), "check_type", "status", "message") for n, f in results]
    return reduce(DataFrame.unionByName, named)


@case(
    "checks_target_unreadable",
    """SELECT v.* FROM (SELECT count(*) AS n FROM customer), LATERAL (VALUES
  (1, 'passed', 'Source readable: ' || n || ' rows, 2 columns', NULL), (2, 'passed', 'Schema matches: 2 columns as expected', NULL),
  (3, 'failed', 'Cannot read source for schema check: Failed to read partitions: text is not valid UTF-8', 'source_not_readable'),
  (4, 'failed', 'Target not readable: Failed to read partitions: text is not valid UTF-8', 'unknown'),
  (5, 'failed', 'No valid timestamps found in column ''name''', 'freshness_exceeded')
) v(check_order, status, message, error_category)""",
)
def checks_target_unreadable(spark, d):
    """All checks of customers whose copies are in another encoding: the target's checks fail, the source's do not."""
    folder = _bare(work_folder(spark, "copies"))
    rows = t.table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("name"))
    rows.write.option("header", "true").csv(f"{folder}/source")
    rows.write.option("header", "true").option("encoding", "ISO-8859-1").csv(f"{folder}/target")
    contract = Contract((ColumnRule("c_custkey", "integer"), ColumnRule("name")), timestamp_column="name")
    source, target = (resolve(spark, f"partition://{folder}/{x}") for x in ("source", "target"))
    found = contract_checks(source, contract, datetime(2002, 1, 1), target, contract)
    return found.select("check_order", "status", "message", "error_category")


@case(
    "contract_files",
    """SELECT c_name AS pipeline, 'lines' AS dataset, c_nationkey AS version, position, "column", type, nullable
FROM customer, (VALUES (0, 'id', 'integer', false), (1, 'note', 'string', true)) v(position, "column", type, nullable)""",
)
def contract_files(spark, d):
    folder = work_folder(spark, "contracts")
    rule = F.struct(F.lit("integer").alias("type"), F.lit(False).alias("nullable"))
    bare = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("nullable"))
    documents = t.table(spark, d, "customer").select(
        F.col("c_name").alias("pipeline_name"),
        F.lit("lines").alias("dataset_name"),
        F.col("c_nationkey").alias("contract_version"),
        F.create_map(F.lit("id"), rule, F.lit("note"), bare).alias("schema"),
        F.struct(F.lit(24).alias("max_age_hours")).alias("freshness"),
        F.struct(F.lit(1).alias("min_row_count")).alias("quality"),
    )
    documents.write.json(folder)
    return explode_columns(read_contract_files(spark, folder, multi_line=False))


# -- sinks -----------------------------------------------------------------


def _events(runs):
    """A run's log: it starts as running and gets its final state later."""
    started = runs.select(
        "pipeline",
        "run_id",
        F.lit(model.RUNNING).alias("status"),
        *[
            F.lit(None).cast(kind).alias(name)
            for name, kind in (
                ("source_row_count", "bigint"),
                ("target_row_count", "bigint"),
                ("failure_reason", "string"),
                ("contract_version", "int"),
            )
        ],
        "started_at",
        F.lit(None).cast("timestamp_ntz").alias("ended_at"),
        "seq",
        F.lit(1).alias("event_no"),
    )
    return started.unionByName(runs.withColumn("event_no", F.lit(2)))


RUN_SQL = """SELECT pipeline, run_id, status, source_row_count, target_row_count, failure_reason, contract_version,
  started_at, ended_at, seq FROM runs"""


@case("sink_runs", sql(RUN_SQL, "runs"))
def sink_runs(spark, d):
    store = ControlStore(spark, work_folder(spark, "store"))
    store.append("runs", _events(t.runs(spark, d)))
    return store.runs().drop("event_no")


@case(
    "sink_checks",
    sql(
        """SELECT pipeline, run_id, check_order, check_type, status, expected, observed, message, error_category
FROM checks""",
        "checks",
    ),
)
def sink_checks(spark, d):
    store = ControlStore(spark, work_folder(spark, "store"))
    for _ in range(2):  # a retried write
        store.append("checks", t.checks(spark, d), date(2001, 1, 1))
    return store.checks(date(2001, 1, 1)).withColumn("check_order", F.col("check_order").cast("int"))


@case(
    "run_health_of_one",
    f"{control.CASES['run_health'][1]} WHERE r.seq = (SELECT max(seq) FROM runs WHERE status = 'failed')",
)
def run_health_of_one(spark, d):
    """Health of the last failed run, from a snapshot of how all runs began and the events that came after it."""
    began = datetime.now(timezone.utc) - timedelta(hours=8)
    folder = work_folder(spark, "store")
    store, events = ControlStore(spark, folder, lambda: began), _events(t.runs(spark, d))
    found = t.incidents(spark, d)
    store.append("runs", events.where("event_no = 1"))
    store.append("checks", t.checks(spark, d), date(2001, 1, 1))
    store.append("incidents", found.withColumn("owner", F.lit("nobody")).withColumn("event_no", F.lit(0)))
    store = ControlStore(spark, folder)
    store.fold()
    store.append("runs", events.where("event_no = 2"))
    store.append("incidents", found.withColumn("event_no", F.lit(1)))
    last = t.runs(spark, d).where(F.col("status") == model.FAILED).agg(F.max_by(F.struct(*model.RUN_KEY), "seq").alias("run"))
    pipeline, run_id = last.select("run.*").first()
    return control.flat_health(
        history.run_health(store.runs(pipeline), store.checks(pipeline=pipeline), store.incidents(pipeline), pipeline, run_id)
    )


@case("sink_incidents", sql("SELECT * FROM incidents", "incidents"))
def sink_incidents(spark, d):
    """Incidents open first; some are acknowledged by a later entry."""
    store = ControlStore(spark, work_folder(spark, "store"))
    found = t.incidents(spark, d)
    store.append("incidents", found.withColumn("status", F.lit(model.OPEN)).withColumn("event_no", F.lit(0)))
    changed = found.where(F.col("status") == model.ACKNOWLEDGED)
    store.append("incidents", changed.withColumn("event_no", F.lit(1)))
    return store.incidents().drop("event_no")


@case(
    "sink_registrations",
    sql("SELECT name, owner, enabled, seq FROM pipelines", "pipelines"),
)
def sink_registrations(spark, d):
    """Registering again under another owner changes nothing."""
    store = ControlStore(spark, work_folder(spark, "store"))
    first = t.pipelines(spark, d)
    store.append("pipelines", first)
    again = first.withColumn("owner", F.lit("someone else")).withColumn("seq", F.col("seq") + 1)
    store.append("pipelines", again)
    store.append("pipelines", registry.to_create(store.pipelines(), again, registry.PIPELINE_KEY))
    return store.pipelines()


# -- streams ---------------------------------------------------------------

LINE_SHAPE = "l_orderkey bigint, l_linenumber int"


def _arriving(spark, d):
    return stream_rows(spark, d, LINE_SHAPE, "parquet", pathGlobFilter="lineitem.parquet")


@case("stream_rows", "SELECT event_id, user_id, event_type FROM events")
def stream_csv_rows(spark, d):
    """Files of delimited rows, picked up by a stream and appended."""
    folder = work_folder(spark, "arriving")
    t.table(spark, d, "events").select("event_id", "user_id", "event_type").write.option("header", "true").csv(
        f"{folder}/in"
    )
    rows = stream_rows(spark, f"{folder}/in", "event_id bigint, user_id bigint, event_type string")
    query = (
        rows.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@case("stream_row_count", "SELECT count(*) AS total_rows FROM lineitem")
def stream_row_count(spark, d):
    folder = work_folder(spark, "counts")
    rows = _arriving(spark, d)
    count_rows(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return row_total(spark, f"{folder}/rows")


@case(
    "stream_unique_keys",
    """SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber
  FROM lineitem)) AS duplicate_count FROM lineitem""",
)
def stream_unique_keys(spark, d):
    folder = work_folder(spark, "keys")
    rows = _arriving(spark, d)
    keys = ["l_orderkey", "l_linenumber"]
    counting = [
        count_rows(rows, f"{folder}/rows", f"{folder}/checkpoint-rows"),
        count_distinct_keys(rows, keys, f"{folder}/keys", f"{folder}/checkpoint-keys"),
    ]
    for query in counting:
        query.awaitTermination()
    return unique_key_totals(spark, f"{folder}/rows", f"{folder}/keys")


@case("stream_alerts", control.CASES["alerts_firing"][1])
def stream_alerts(spark, d):
    """The alert rules over stored tables; incidents and half of the checks arrive after the runs."""
    folder = work_folder(spark, "alerts")
    store = ControlStore(spark, f"{folder}/store")
    store.append("pipelines", t.pipelines(spark, d))
    checks, late = t.checks(spark, d), F.col("check_order") % 2 == 0
    store.append("checks", checks.where(~late), date(2001, 1, 1))
    store.append("runs", _events(t.runs(spark, d)))
    watch_alerts(store, f"{folder}/out", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    store.append("checks", checks.where(late), date(2001, 1, 1))
    store.append("incidents", t.incidents(spark, d).withColumn("event_no", F.lit(0)))
    watch_alerts(store, f"{folder}/out", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    states = spark.read.parquet(f"{folder}/out")
    newest = states.agg(F.max("epoch").alias("epoch"))
    return states.join(newest, "epoch", "left_semi").drop("epoch")
