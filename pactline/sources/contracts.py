"""Contract documents as Python values and as a Spark table."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pactline import model

SCHEMA_MAP = "map<string, struct<type: string, nullable: boolean>>"


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str = "string"
    nullable: bool = True


@dataclass(frozen=True)
class Contract:
    """One version of what a dataset promises."""

    columns: tuple[ColumnRule, ...]
    max_age_hours: float = model.DEFAULT_MAX_AGE_HOURS
    timestamp_column: str = model.DEFAULT_TIMESTAMP_COLUMN
    min_row_count: int = 0
    max_row_count: int | None = None
    max_row_count_diff_pct: float = model.DEFAULT_MAX_DIFF_PCT
    unique_keys: tuple[str, ...] = ()
    version: int = 1

    @classmethod
    def from_documents(
        cls,
        schema_definition: Mapping[str, Mapping[str, Any]],
        freshness: Mapping[str, Any] | None = None,
        quality_rules: Mapping[str, Any] | None = None,
        version: int = 1,
    ) -> Contract:
        freshness = freshness or {}
        quality_rules = quality_rules or {}
        known = {
            "max_age_hours": freshness.get("max_age_hours"),
            "timestamp_column": freshness.get("timestamp_column"),
            "min_row_count": quality_rules.get("min_row_count"),
            "max_row_count": quality_rules.get("max_row_count"),
            "max_row_count_diff_pct": quality_rules.get("max_row_count_diff_pct"),
            "unique_keys": tuple(quality_rules.get("unique_keys") or ()),
        }
        columns = []
        for name, rule in schema_definition.items():
            given = {k: v for k, v in rule.items() if k in ("type", "nullable") and v is not None}
            columns.append(ColumnRule(name, **given))
        return cls(
            columns=tuple(columns),
            version=version,
            **{k: v for k, v in known.items() if v is not None},
        )

    @classmethod
    def from_row(cls, row: Row) -> Contract:
        """Build from one row of the contract table."""
        return cls.from_documents(
            json.loads(row["schema_definition"]),
            json.loads(row["freshness"] or "{}"),
            json.loads(row["quality_rules"] or "{}"),
            row["version"],
        )

    @property
    def column_names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)


def contract_rows(
    spark: SparkSession, entries: Iterable[Mapping[str, Any]], first_seq: int = 0
) -> DataFrame:
    """Contract table rows from document entries.

    An entry has pipeline, dataset, version and the three documents, as
    mappings or as JSON text.
    """

    def text(document: Any) -> str:
        if document is None:
            return "{}"
        return document if isinstance(document, str) else json.dumps(document)

    rows = [
        (
            e["pipeline"],
            e["dataset"],
            int(e.get("version", 1)),
            text(e["schema_definition"]),
            text(e.get("freshness")),
            text(e.get("quality_rules")),
            first_seq + i,
        )
        for i, e in enumerate(entries)
    ]
    return spark.createDataFrame(rows, model.CONTRACTS)


def read_contract_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Contract table rows from JSON files: one document per file, or one per line.

    The file form has pipeline_name, dataset_name, contract_version, schema,
    freshness and quality; it is parsed where the files are read.
    """
    shape = (
        "pipeline_name string, dataset_name string, contract_version int, "
        "schema map<string, struct<type: string, nullable: boolean>>, "
        "freshness string, quality string"
    )
    keep = {"ignoreNullFields": "true"}
    return (
        spark.read.schema(shape)
        .json(path, multiLine=multi_line)
        .select(
            F.col("pipeline_name").alias("pipeline"),
            F.col("dataset_name").alias("dataset"),
            F.col("contract_version").alias("version"),
            F.to_json("schema", keep).alias("schema_definition"),
            F.coalesce("freshness", F.lit("{}")).alias("freshness"),
            F.coalesce("quality", F.lit("{}")).alias("quality_rules"),
            F.lit(0).cast("bigint").alias("seq"),
        )
    )


def contract_from_yaml(text: str) -> tuple[str, str, Contract]:
    """(pipeline, dataset, contract) from a YAML document; needs a YAML reader."""
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("YAML contracts need the yaml package; use JSON instead") from exc
    doc = yaml.safe_load(text)
    contract = Contract.from_documents(
        doc["schema"], doc.get("freshness"), doc.get("quality"), doc.get("contract_version", 1)
    )
    return doc["pipeline_name"], doc["dataset_name"], contract


def explode_columns(contracts: DataFrame) -> DataFrame:
    """One row per contract column, with the default type and nullability filled in."""
    parsed = F.from_json("schema_definition", SCHEMA_MAP)
    return contracts.select(
        "pipeline", "dataset", "version", F.posexplode(parsed).alias("position", "column", "rule")
    ).select(
        "pipeline",
        "dataset",
        "version",
        "position",
        "column",
        F.coalesce("rule.type", F.lit("string")).alias("type"),
        F.coalesce("rule.nullable", F.lit(True)).alias("nullable"),
    )
