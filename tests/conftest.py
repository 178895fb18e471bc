import os
import sys
from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pactline import Contract  # noqa: E402
from pactline.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configure(SparkSession.builder.master("local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# An invented dataset: one reading of each gauge in a harbour.
TIDE_TYPES = {
    "gauge_no": "integer",
    "station_code": "string",
    "observed_on": "date",
    "level_mm": "integer",
    "wind_kn": "integer",
    "period_s": "integer",
    "salinity": "decimal",
    "basin": "string",
    "crew": "string",
    "calibrated_on": "date",
}
TIDE_SCHEMA = {n: {"type": k, "nullable": False} for n, k in TIDE_TYPES.items()}
TIDE_FRESHNESS = {"max_age_hours": 24, "timestamp_column": "observed_on"}
TIDE_QUALITY = {"unique_keys": ["gauge_no"], "min_row_count": 1, "max_row_count": 40, "max_row_count_diff_pct": 5}
AS_OF = datetime(2026, 8, 1, 12)


@pytest.fixture
def tides():
    return Contract.from_documents(TIDE_SCHEMA, TIDE_FRESHNESS, TIDE_QUALITY)


def tide_rows(count=5, day="2026-08-01", **changes):
    """Rows of a valid file of readings; changes replace columns, by value or by row number."""
    rows = []
    for i in range(1, count + 1):
        row = {
            "gauge_no": str(i), "station_code": f"G{i % 3}-{i}", "observed_on": day, "level_mm": str(1200 + i), "wind_kn": "14",
            "period_s": "11", "salinity": "31.4", "basin": "north", "crew": "dawn", "calibrated_on": "2026-02-11",
        }
        for name, value in changes.items():
            row[name] = value(i) if callable(value) else value
        rows.append(row)
    return rows


@pytest.fixture
def write_csv(tmp_path):
    import csv

    def write(name, rows, columns=None):
        path = tmp_path / name
        with path.open("w", newline="", encoding="utf-8") as file:
            writer = csv.DictWriter(file, columns or list(rows[0]))
            writer.writeheader()
            writer.writerows(rows)
        return str(path)

    return write


def by_type(frame):
    return {r["check_type"]: r for r in frame.collect()}


@contextmanager
def small_splits(spark):
    """Cut files of a few kilobytes the way large ones are."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key in keys:
        spark.conf.set(key, "1kb")
    try:
        yield
    finally:
        for key in keys:
            spark.conf.unset(key)
