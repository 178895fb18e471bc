"""Contract checks over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pactline.functions import timestamps
from pactline.functions.text import two_decimals
from pactline.operators import checks, measures
from pactline.sources.contracts import ColumnRule, Contract
from pactline.sources.resolve import from_frame, resolve
from verification import tables as t

CASES = {}
AS_OF = datetime(2001, 11, 6, 7, 30)
EVENTS_AS_OF = datetime(2024, 1, 31)


def case(name, text=None):
    def keep(function):
        CASES[name] = (function, text)
        return function

    return keep


def _source(spark, d, name):
    return resolve(spark, f"local://{d}/{name}.parquet")


LINE_RULES = {
    "l_orderkey": ("integer", False),
    "l_partkey": ("integer", False),
    "l_suppkey": ("integer", False),
    "l_linenumber": ("integer", False),
    "l_quantity": ("decimal", False),
    "l_extendedprice": ("decimal", False),
    "l_discount": ("decimal", True),
    "l_returnflag": ("integer", False),
    "l_shipdate": ("timestamp", False),
    "l_comment": ("string", True),
}


def _contract(rules, **rest):
    return Contract(tuple(ColumnRule(n, k, nullable) for n, (k, nullable) in rules.items()), **rest)


LINES = _contract(
    LINE_RULES,
    timestamp_column="l_shipdate",
    max_age_hours=48,
    min_row_count=1,
    max_row_count=50,
    max_row_count_diff_pct=5,
    unique_keys=("l_orderkey", "l_linenumber"),
)
ORDERS = _contract(
    {
        "o_orderkey": ("integer", False),
        "o_custkey": ("integer", False),
        "o_orderstatus": ("string", False),
        "o_totalprice": ("decimal", False),
        "o_orderdate": ("date", False),
        "o_orderpriority": ("string", True),
    }
)

LINE_COLUMNS = sorted(LINE_RULES)
LINE_DATA = [
    "l_discount",
    "l_extendedprice",
    "l_linenumber",
    "l_linestatus",
    "l_orderkey",
    "l_partkey",
    "l_quantity",
    "l_returnflag",
    "l_shipdate",
    "l_suppkey",
    "l_tax",
]
ORDER_COLUMNS = sorted(ORDERS.column_names)


def _json(names):
    return "[" + ",".join(f'"{n}"' for n in names) + "]"


READABLE_SQL = """SELECT 1 AS check_order, 'source_readability' AS check_type,
  CASE WHEN count(*) = 0 THEN 'failed' ELSE 'passed' END AS status,
  '{"parseable":true,"row_count":"> 0"}' AS expected,
  '{"parseable":true,"row_count":' || count(*) || ',"columns":11}' AS observed,
  'Source readable: ' || count(*) || ' rows, 11 columns' AS message, CAST(NULL AS VARCHAR) AS error_category
FROM lineitem"""

SCHEMA_SQL = f"""SELECT 2 AS check_order, 'schema_compatibility' AS check_type, 'failed' AS status,
  '{{"columns":{_json(LINE_COLUMNS)},"column_count":10}}' AS expected,
  '{{"columns":{_json(LINE_DATA)},"column_count":11,"missing":["l_comment"],"unexpected":["l_linestatus","l_tax"]}}'
    AS observed,
  'Missing columns: [''l_comment'']; Unexpected columns: [''l_linestatus'', ''l_tax'']; Type violations ('
    || count(l_returnflag) || '): Type mismatch in ''l_returnflag'' at row 1: expected integer, got '''
    || (SELECT l_returnflag FROM lineitem LIMIT 1) || '''' AS message, 'schema_mismatch' AS error_category
FROM lineitem"""

TARGET_SQL = f"""SELECT 3 AS check_order, 'target_schema_compatibility' AS check_type,
  CASE WHEN count(*) > 0 THEN 'passed' END AS status,
  '{{"columns":{_json(ORDER_COLUMNS)},"column_count":6}}' AS expected,
  '{{"columns":{_json(ORDER_COLUMNS)},"column_count":6}}' AS observed,
  'Schema matches: 6 columns as expected' AS message, CAST(NULL AS VARCHAR) AS error_category
FROM orders"""

COUNT_SQL = """SELECT 4 AS check_order, 'row_count' AS check_type, 'failed' AS status,
  '{"min_row_count":1,"max_row_count":50,"unique_keys":["l_orderkey","l_linenumber"]}' AS expected,
  '{"source_row_count":' || n || ',"target_row_count":' || target || ',"duplicate_count":' || n - keys || '}' AS observed,
  'Source row count ' || n || ' outside range [1, 50]; Found ' || n - keys
    || ' duplicate rows on keys [''l_orderkey'', ''l_linenumber'']; Source-target mismatch: ' || n || ' vs '
    || target || ' (' || CAST(round(abs(n - target) / n * 100, 2) AS DOUBLE) || '% diff, max 5%)' AS message,
  'row_count_out_of_range' AS error_category
FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS keys,
  (SELECT count(*) FROM orders) AS target FROM lineitem)"""

FRESH_SQL = """SELECT 5 AS check_order, 'freshness' AS check_type,
  CASE WHEN age > 48 THEN 'failed' ELSE 'passed' END AS status,
  '{"max_age_hours":48,"timestamp_column":"l_shipdate"}' AS expected,
  '{"latest_timestamp":"' || strftime(latest, '%Y-%m-%dT%H:%M:%S') || '+00:00","age_hours":' || round(age, 2) || '}'
    AS observed,
  'Data is ' || CASE WHEN age > 48 THEN 'stale' ELSE 'fresh' END || ': ' || round(age, 2) || 'h old (max 48h)' AS message,
  CASE WHEN age > 48 THEN 'freshness_exceeded' END AS error_category
FROM (SELECT max(l_shipdate) AS latest,
  (epoch_us(TIMESTAMP '2001-11-06 07:30:00') - epoch_us(max(l_shipdate))) / 3600000000.0 AS age FROM lineitem)"""


@case("check_readability", READABLE_SQL)
def check_readability(spark, d):
    return checks.check_readability(_source(spark, d, "lineitem"))


@case("check_schema", SCHEMA_SQL)
def check_schema(spark, d):
    return checks.check_schema(_source(spark, d, "lineitem"), LINES)


@case("check_target_schema", TARGET_SQL)
def check_target_schema(spark, d):
    return checks.check_target_schema(_source(spark, d, "orders"), ORDERS)


@case("check_row_count", COUNT_SQL)
def check_row_count(spark, d):
    return checks.check_row_count(_source(spark, d, "lineitem"), LINES, _source(spark, d, "orders"))


@case("check_freshness", FRESH_SQL)
def check_freshness(spark, d):
    return checks.check_freshness(_source(spark, d, "lineitem"), LINES, AS_OF)


@case("contract_run", " UNION ALL ".join([READABLE_SQL, SCHEMA_SQL, TARGET_SQL, COUNT_SQL, FRESH_SQL]))
def contract_run(spark, d):
    return checks.contract_checks(
        _source(spark, d, "lineitem"), LINES, AS_OF, _source(spark, d, "orders"), ORDERS
    )


@case(
    "check_reconciliation",
    """SELECT CASE WHEN apart > 1 THEN 'failed' ELSE 'passed' END AS status, s AS source_rows, k AS target_rows,
  CASE WHEN apart > 1 THEN 'Source-target mismatch: ' || s || ' vs ' || k || ' (' || CAST(round(apart, 2) AS DOUBLE)
    || '% diff, max 1%)' ELSE 'Row count ' || s || ' within range [0, inf]' END AS message
FROM (SELECT s, k, abs(s - k) / s * 100 AS apart FROM (SELECT (SELECT count(*) FROM orders) AS s,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS k))""",
)
def check_reconciliation(spark, d):
    orders = from_frame(t.table(spark, d, "orders"))
    loaded = from_frame(t.table(spark, d, "lineitem").select("l_orderkey").distinct())
    contract = Contract((ColumnRule("o_orderkey", "integer"),), max_row_count_diff_pct=1)
    found = checks.check_row_count(orders, contract, loaded)

    def at(name):
        return F.get_json_object("observed", f"$.{name}").cast("bigint")

    return found.select(
        "status", at("source_row_count").alias("source_rows"), at("target_row_count").alias("target_rows"), "message"
    )


# One text column with every kind of good and bad value, chosen by the row.
MIXED_SQL = """mixed AS (SELECT l_orderkey, CASE l_linenumber
    WHEN 1 THEN CAST(l_orderkey AS VARCHAR)
    WHEN 2 THEN '-' || CAST(l_partkey AS VARCHAR)
    WHEN 3 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR)
    WHEN 4 THEN CASE l_returnflag WHEN 'A' THEN ' ' || l_suppkey || '.5 ' WHEN 'N' THEN '1_000' ELSE l_suppkey || 'd' END
    WHEN 5 THEN CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN NULL ELSE '+' || l_suppkey || 'e5' END
    WHEN 6 THEN CASE l_returnflag WHEN 'A' THEN 'nan' WHEN 'N' THEN '-Infinity' ELSE '٣²' END
    ELSE l_returnflag || l_linestatus END AS v FROM lineitem)"""


def _mixed(spark, d):
    flag = F.col("l_returnflag")

    def text(name):
        return F.col(name).cast("string")

    value = (
        F.when(F.col("l_linenumber") == 1, text("l_orderkey"))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("-"), text("l_partkey")))
        .when(F.col("l_linenumber") == 3, F.col("l_shipdate").cast("date").cast("string"))
        .when(
            F.col("l_linenumber") == 4,
            F.when(flag == "A", F.concat(F.lit(" "), text("l_suppkey"), F.lit(".5 ")))
            .when(flag == "N", "1_000")
            .otherwise(F.concat(text("l_suppkey"), F.lit("d"))),
        )
        .when(
            F.col("l_linenumber") == 5,
            F.when(flag == "A", "")
            .when(flag == "N", F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("+"), text("l_suppkey"), F.lit("e5"))),
        )
        .when(F.col("l_linenumber") == 6, F.when(flag == "A", "nan").when(flag == "N", "-Infinity").otherwise("٣²"))
        .otherwise(F.concat(flag, "l_linestatus"))
    )
    return t.table(spark, d, "lineitem").select("l_orderkey", value.alias("v"))


KINDS = ("string", "integer", "decimal", "date", "timestamp")
VALID_SQL = {
    "string": "true",
    "integer": r"regexp_full_match(v, '[0-9٣²]+')",
    "decimal": r"regexp_full_match(trim(v), '[+-]?((?i:nan|infinity|inf)|([0-9]+(_[0-9]+)*)([.][0-9]*)?([eE][+-]?[0-9]+)?)')",
    "date": r"regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')",
    "timestamp": r"regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')",
}


@case(
    "check_column_violations",
    f"WITH {MIXED_SQL} "
    + " UNION ALL ".join(
        f"""SELECT 'as_{k}' AS "column", '{k}' AS type, count(*) FILTER (v IS NULL OR v = '') AS null_violations,
  count(*) FILTER (v <> '' AND NOT {VALID_SQL[k]}) AS type_violations FROM mixed"""
        for k in KINDS
    ),
)
def check_column_violations(spark, d):
    frame = _mixed(spark, d).select(*[F.col("v").alias(f"as_{k}") for k in KINDS])
    contract = Contract(tuple(ColumnRule(f"as_{k}", k, False) for k in KINDS))
    return measures.column_violations(from_frame(frame), contract)


def _validator_case(kind):
    def query(spark, d):
        frame = from_frame(_mixed(spark, d))
        contract = Contract((ColumnRule("l_orderkey", "integer", False), ColumnRule("v", kind, False)))
        return checks.check_schema(frame, contract).select("status", "message", "error_category")

    # Without a file position the lowest bad value is the sample.
    bad = f"v <> '' AND NOT {VALID_SQL[kind]}"
    text = f"""WITH {MIXED_SQL} SELECT 'failed' AS status,
  'Null violations (' || count(*) FILTER (v IS NULL OR v = '') || '): Null in non-nullable column ''v'''
  || CASE WHEN count(*) FILTER ({bad}) > 0 THEN '; Type violations (' || count(*) FILTER ({bad})
    || '): Type mismatch in ''v'': expected {kind}, got ''' || min(v) FILTER ({bad}) || '''' ELSE '' END AS message,
  'schema_mismatch' AS error_category FROM mixed"""
    CASES[f"check_types_{kind}"] = (query, text)


for _kind in KINDS:
    _validator_case(_kind)


@case(
    "check_texts_as_numbers",
    """SELECT 'failed' AS status, count(*) FILTER (text <> '' AND NOT regexp_full_match(text, '[0-9]+')) AS documents,
  (SELECT count(*) FROM pages WHERE html <> '') AS pages,
  (SELECT count(*) FROM conversations WHERE text <> '') AS turns FROM documents""",
)
def check_texts_as_numbers(spark, d):
    """Whole texts against the number and date rules."""

    def violations(name, column, kind):
        source = from_frame(t.table(spark, d, name))
        contract = Contract((ColumnRule(column, kind, False),))
        return measures.measure(source, contract, freshness=False).select("type_violations")

    found = violations("documents", "text", "integer").withColumnRenamed("type_violations", "documents")
    return found.select(
        F.when(F.col("documents") > 0, "failed").otherwise("passed").alias("status"),
        "documents",
        violations("pages", "html", "decimal").scalar().alias("pages"),
        violations("conversations", "text", "date").scalar().alias("turns"),
    )


@case(
    "check_null_keys",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT nullif(o_orderpriority, '1-URGENT'), o_orderstatus,
  o_custkey FROM orders)) AS duplicates FROM orders""",
)
def check_null_keys(spark, d):
    """Null key values equal each other; a key column that is absent reads as empty."""
    orders = t.table(spark, d, "orders").withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT"))
    )
    return measures.duplicate_rows(orders, ["o_orderpriority", "o_orderstatus", "o_custkey", "absent"])


@case(
    "column_drift",
    """WITH expected AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS dataset, 'priority ' || o_orderpriority AS "column"
  FROM orders WHERE o_orderstatus <> 'P'),
observed AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS dataset, 'priority ' || o_orderpriority AS "column"
  FROM orders WHERE o_orderstatus <> 'F')
SELECT *, 'missing' AS drift FROM (SELECT * FROM expected EXCEPT SELECT * FROM observed)
UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM observed EXCEPT SELECT * FROM expected)""",
)
def column_drift(spark, d):
    """Every customer is a dataset whose columns are the priorities of its orders."""
    columns = t.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset"),
        F.concat(F.lit("priority "), "o_orderpriority").alias("column"),
        "o_orderstatus",
    )
    expected = columns.where(F.col("o_orderstatus") != "P").select("dataset", "column").distinct()
    observed = columns.where(F.col("o_orderstatus") != "F").select("dataset", "column").distinct()
    return measures.column_drift(expected, observed)


# -- freshness -------------------------------------------------------------

TEXT_TIMES_SQL = """SELECT event_type, CASE event_type
    WHEN 'click' THEN date_trunc('day', ts)
    WHEN 'view' THEN date_trunc('second', ts)
    WHEN 'purchase' THEN date_trunc('millisecond', ts)
    WHEN 'signup' THEN date_trunc('minute', ts) - INTERVAL 150 MINUTE
    WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN date_trunc('hour', ts) END END AS t FROM events"""


def _text_times(spark, d):
    """Event times written in several ISO forms, some of them no times at all."""
    ts, kind = F.col("ts"), F.col("event_type")
    form = (
        F.when(kind == "click", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "purchase", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(kind == "signup", F.date_format(ts, "yyyyMMdd'T'HHmm'+02:30'"))
        .when(F.col("user_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH"))
        .otherwise(F.date_format(ts, "dd.MM.yyyy HH:mm"))
    )
    return t.table(spark, d, "events").select("event_type", "user_id", form.alias("written"))


@case(
    "freshness_text_times",
    f"""SELECT event_type, count(*) AS row_count, max(t) AS latest FROM ({TEXT_TIMES_SQL}) GROUP BY event_type""",
)
def freshness_text_times(spark, d):
    found = measures.latest_by_key(_text_times(spark, d), "event_type", "written")
    return found.withColumn("latest", timestamps.micros_to_ntz(F.col("latest")))


@case(
    "check_freshness_text",
    f"""SELECT CASE WHEN age <= 1 THEN 'passed' ELSE 'failed' END AS status,
  'Data is ' || CASE WHEN age <= 1 THEN 'fresh' ELSE 'stale' END || ': ' || round(age, 2) || 'h old (max 1h)' AS message
FROM (SELECT (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(t))) / 3600000000.0 AS age
  FROM ({TEXT_TIMES_SQL}))""",
)
def check_freshness_text(spark, d):
    contract = Contract((ColumnRule("written"),), timestamp_column="written", max_age_hours=1)
    found = checks.check_freshness(from_frame(_text_times(spark, d)), contract, EVENTS_AS_OF)
    return found.select("status", "message")


@case(
    "freshness_by_key",
    """SELECT user_id, count(*) AS row_count, round(age, 2) AS age_hours, age <= 24 AS fresh FROM (
  SELECT user_id, value, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts) OVER (PARTITION BY user_id)))
    / 3600000000.0 AS age FROM events) GROUP BY user_id, age""",
)
def freshness_by_key(spark, d):
    found = measures.latest_by_key(t.table(spark, d, "events"), "user_id", "ts")
    age = checks.age_hours(F.col("latest"), EVENTS_AS_OF)
    return found.select("user_id", "row_count", F.round(age, 2).alias("age_hours"), (age <= 24).alias("fresh"))


@case(
    "freshness_no_times",
    """SELECT 'failed' AS status, 'No valid timestamps found in column ''role''' AS message,
  '{"latest_timestamp":null,"parseable_timestamps":0}' AS observed FROM conversations HAVING count(*) > 0""",
)
def freshness_no_times(spark, d):
    contract = Contract((ColumnRule("role"),), timestamp_column="role")
    found = checks.check_freshness(_source(spark, d, "conversations"), contract, EVENTS_AS_OF)
    return found.select("status", "message", "observed")


# -- many datasets in one table --------------------------------------------


@case(
    "contract_run_by_key",
    """WITH per AS (SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS latest,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem i
      WHERE i.l_suppkey = o.l_suppkey)) AS dup,
    (epoch_us(TIMESTAMP '2001-11-06 07:30:00') - epoch_us(max(l_shipdate))) / 3600000000.0 AS age
  FROM lineitem o GROUP BY l_suppkey)
SELECT l_suppkey, 1 AS check_order, 'passed' AS status, 'Source readable: ' || n || ' rows, 11 columns' AS message FROM per
UNION ALL SELECT l_suppkey, 2, 'failed', 'Missing columns: [''l_comment'']; Unexpected columns: [''l_linestatus'', ''l_tax'']; Type violations (' || n || ')' FROM per
UNION ALL SELECT l_suppkey, 3, 'skipped', 'No target to validate' FROM per
UNION ALL SELECT l_suppkey, 4, CASE WHEN n > 50 OR dup > 0 THEN 'failed' ELSE 'passed' END,
  CASE WHEN n > 50 OR dup > 0 THEN concat_ws('; ',
    CASE WHEN n > 50 THEN 'Source row count ' || n || ' outside range [1, 50]' END,
    CASE WHEN dup > 0 THEN 'Found ' || dup || ' duplicate rows on keys [''l_orderkey'', ''l_linenumber'']' END)
  ELSE 'Row count ' || n || ' within range [1, 50]' END FROM per
UNION ALL SELECT l_suppkey, 5, CASE WHEN age > 48 THEN 'failed' ELSE 'passed' END,
  'Data is ' || CASE WHEN age > 48 THEN 'stale' ELSE 'fresh' END || ': ' || round(age, 2) || 'h old (max 48h)' FROM per""",
)
def contract_run_by_key(spark, d):
    found = checks.contract_checks_by_key(_source(spark, d, "lineitem"), LINES, AS_OF, ["l_suppkey"])
    return found.select("l_suppkey", "check_order", "status", "message")


SHIPMENT_RULES = {
    "supplier": ("integer", False),
    "l_orderkey": ("integer", False),
    "l_linenumber": ("integer", False),
    "flag": ("integer", False),
    "price": ("decimal", False),
    "l_shipdate": ("timestamp", False),
}
SHIPMENTS = _contract(
    SHIPMENT_RULES,
    timestamp_column="l_shipdate",
    max_age_hours=48,
    max_row_count=600,
    max_row_count_diff_pct=5,
    unique_keys=("l_orderkey", "l_linenumber"),
)
COPIES = _contract({"supplier": ("integer", False), "flag": ("integer", False)})


def _shipments(spark, d):
    """Order lines by supplier, some with a missing price or a flag that is no number."""
    return t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("supplier"),
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        "l_quantity",
        F.when(F.col("l_returnflag") == "N", "7").otherwise(F.concat("l_returnflag", "l_linenumber")).alias("flag"),
        F.when(F.col("l_quantity") <= 45, F.col("l_extendedprice")).alias("price"),
    )


@case(
    "run_by_key",
    """WITH s AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_shipdate, l_quantity,
    CASE WHEN l_returnflag = 'N' THEN '7' ELSE l_returnflag || l_linenumber END AS flag, l_quantity > 45 AS unpriced FROM lineitem),
  source AS (SELECT k, count(*) AS n, count(*) FILTER (unpriced) AS nulls, count(*) FILTER (flag <> '7') AS bad,
    min(flag) FILTER (flag <> '7') AS worst, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dup,
    (epoch_us(TIMESTAMP '2001-11-06 07:30:00') - epoch_us(max(l_shipdate))) / 3600000000.0 AS age FROM s GROUP BY 1),
  target AS (SELECT CASE WHEN k % 11 = 0 THEN k + 1000000 ELSE k END AS k, count(*) AS m, count(*) FILTER (flag <> '7') AS bad,
    min(flag) FILTER (flag <> '7') AS worst FROM s WHERE l_quantity <= 48 AND k % 7 <> 0 GROUP BY 1),
  per AS (SELECT coalesce(source.k, target.k) AS supplier, coalesce(n, 0) AS n, nulls, source.bad, source.worst, dup, age,
    coalesce(m, 0) AS m, coalesce(target.bad, 0) AS target_bad, target.worst AS target_worst
    FROM source FULL JOIN target ON source.k = target.k)
SELECT supplier, 1 AS check_order, CASE WHEN n = 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN n = 0 THEN 'Source has 0 rows' ELSE 'Source readable: ' || n || ' rows, 6 columns' END AS message FROM per
UNION ALL SELECT supplier, 2, CASE WHEN nulls + bad > 0 THEN 'failed' ELSE 'passed' END,
  CASE WHEN nulls + bad = 0 THEN 'Schema matches: 6 columns as expected' ELSE concat_ws('; ',
    CASE WHEN nulls > 0 THEN 'Null violations (' || nulls || '): Null in non-nullable column ''price''' END,
    CASE WHEN bad > 0 THEN 'Type violations (' || bad || '): Type mismatch in ''flag'': expected integer, got ''' || worst || '''' END)
  END FROM per WHERE n > 0
UNION ALL SELECT supplier, 3, CASE WHEN target_bad > 0 THEN 'failed' ELSE 'passed' END,
  CASE WHEN target_bad = 0 THEN 'Schema matches: 2 columns as expected' ELSE
    'Type violations (' || target_bad || '): Type mismatch in ''flag'': expected integer, got ''' || target_worst || '''' END
  FROM per WHERE n > 0
UNION ALL SELECT supplier, 4, CASE WHEN n > 600 OR dup > 0 OR abs(n - m) / n * 100 > 5 THEN 'failed' ELSE 'passed' END,
  CASE WHEN n > 600 OR dup > 0 OR abs(n - m) / n * 100 > 5 THEN concat_ws('; ',
    CASE WHEN n > 600 THEN 'Source row count ' || n || ' outside range [0, 600]' END,
    CASE WHEN dup > 0 THEN 'Found ' || dup || ' duplicate rows on keys [''l_orderkey'', ''l_linenumber'']' END,
    CASE WHEN abs(n - m) / n * 100 > 5 THEN 'Source-target mismatch: ' || n || ' vs ' || m || ' ('
      || CAST(round(abs(n - m) / n * 100, 2) AS DOUBLE) || '% diff, max 5%)' END)
  ELSE 'Row count ' || n || ' within range [0, 600]' END FROM per WHERE n > 0
UNION ALL SELECT supplier, 5, CASE WHEN age > 48 THEN 'failed' ELSE 'passed' END,
  'Data is ' || CASE WHEN age > 48 THEN 'stale' ELSE 'fresh' END || ': ' || round(age, 2) || 'h old (max 48h)' FROM per WHERE n > 0""",
)
def run_by_key(spark, d):
    """Whole runs of all suppliers' shipments against copies that lack rows and suppliers, and have suppliers of their own."""
    rows = _shipments(spark, d)
    number = F.col("supplier")
    copies = rows.where((F.col("l_quantity") <= 48) & (number % 7 != 0)).select(
        F.when(number % 11 == 0, number + 1000000).otherwise(number).alias("supplier"), "flag"
    )
    found = checks.contract_checks_by_key(
        from_frame(rows.drop("l_quantity")), SHIPMENTS, AS_OF, ["supplier"],
        target=from_frame(copies), target_contract=COPIES, samples=True,
    )
    return found.select("supplier", "check_order", "status", "message")


@case(
    "number_text",
    """SELECT o_orderkey, CAST(round(o_totalprice / 7, 2) AS VARCHAR) AS shown FROM orders""",
)
def number_text(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", two_decimals(F.col("o_totalprice") / 7).alias("shown"))
