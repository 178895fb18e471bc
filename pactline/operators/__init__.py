"""Contract checks: one aggregation pass per dataset, verdicts from its single row."""

from pactline.operators.checks import (
    check_freshness,
    check_readability,
    check_row_count,
    check_schema,
    check_target_schema,
    contract_checks,
    contract_checks_by_key,
)
from pactline.operators.measures import (
    column_drift,
    column_violations,
    duplicate_rows,
    latest_by_key,
    measure,
)

__all__ = [
    "check_freshness",
    "check_readability",
    "check_row_count",
    "check_schema",
    "check_target_schema",
    "column_drift",
    "column_violations",
    "contract_checks",
    "contract_checks_by_key",
    "duplicate_rows",
    "latest_by_key",
    "measure",
]
