"""Names and table shapes shared by every module."""

from __future__ import annotations

# Statuses, check types and defaults of the data-contract model.
PASSED = "passed"
FAILED = "failed"
SKIPPED = "skipped"
REGISTERED = "registered"
RUNNING = "running"
LATE = "late"

OPEN = "open"
ACKNOWLEDGED = "acknowledged"
RESOLVED = "resolved"

SOURCE_READABILITY = "source_readability"
SCHEMA_COMPATIBILITY = "schema_compatibility"
TARGET_SCHEMA_COMPATIBILITY = "target_schema_compatibility"
ROW_COUNT = "row_count"
FRESHNESS = "freshness"

CHECK_ORDER = (
    SOURCE_READABILITY,
    SCHEMA_COMPATIBILITY,
    TARGET_SCHEMA_COMPATIBILITY,
    ROW_COUNT,
    FRESHNESS,
)
SCHEMA_CHECKS = (SCHEMA_COMPATIBILITY, TARGET_SCHEMA_COMPATIBILITY)

RUN_STATUSES = (REGISTERED, RUNNING, PASSED, FAILED, LATE)
DATASET_ROLES = ("source", "target")

DEFAULT_MAX_AGE_HOURS = 24
DEFAULT_TIMESTAMP_COLUMN = "snapshot_date"
DEFAULT_MAX_DIFF_PCT = 100

MAX_CONCURRENT_RUNS = 3
DEFAULT_PAGE_SIZE = 20
SCHEMA_DRIFT_PANEL_ROWS = 50

# run state -> (incident type, severity)
INCIDENT_RULES = {
    FAILED: ("contract_violation", "medium"),
    LATE: ("late_arrival", "high"),
}

# Every error category a check result or a rejection can carry.
ERROR_CATEGORIES = (
    "source_not_found",
    "source_not_readable",
    "source_timeout",
    "schema_mismatch",
    "schema_missing_columns",
    "schema_unexpected_columns",
    "schema_type_violation",
    "row_count_out_of_range",
    "duplicate_keys",
    "freshness_exceeded",
    "database_error",
    "network_error",
    "authentication_error",
    "timeout",
    "duplicate_run",
    "concurrent_limit_exceeded",
    "unknown",
)

# Table shapes. Timestamps are zone-free UTC, documents are JSON text.
PIPELINES = "name string, owner string, enabled boolean, seq bigint"
DATASETS = "pipeline string, name string, role string, location string, seq bigint"
CONTRACTS = (
    "pipeline string, dataset string, version int, schema_definition string, "
    "freshness string, quality_rules string, seq bigint"
)
RUNS = (
    "pipeline string, run_id string, status string, source_row_count bigint, "
    "target_row_count bigint, failure_reason string, contract_version int, "
    "started_at timestamp_ntz, ended_at timestamp_ntz, seq bigint, event_no int"
)
CHECKS = (
    "pipeline string, run_id string, check_order int, check_type string, "
    "status string, expected string, observed string, message string, "
    "error_category string, attempt int"
)
INCIDENTS = (
    "pipeline string, run_id string, incident_type string, severity string, "
    "owner string, status string, retryable boolean, failure_summary string, "
    "first_observed_at timestamp_ntz, event_no int"
)
NOTIFICATIONS = (
    "alert_name string, status string, payload string, "
    "created_at timestamp_ntz, seq bigint"
)

CONTROL_TABLES = {
    "pipelines": PIPELINES,
    "datasets": DATASETS,
    "contracts": CONTRACTS,
    "runs": RUNS,
    "checks": CHECKS,
    "incidents": INCIDENTS,
    "notifications": NOTIFICATIONS,
}

RUN_KEY = ["pipeline", "run_id"]
