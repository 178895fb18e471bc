"""Keyed lookups and first-writer-wins registration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.sources.contracts import SCHEMA_MAP

PIPELINE_KEY = ["name"]
DATASET_KEY = ["pipeline", "name"]
CONTRACT_KEY = ["pipeline", "dataset", "version"]


def first_written(rows: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The first row of every key; later ones with another body are ignored."""
    rest = [c for c in rows.columns if c not in keys]
    ranked = F.struct(order, *[c for c in rest if c != order])
    first = rows.groupBy(*keys).agg(F.min(ranked).alias("first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in rows.columns])


def newest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of every key that comes last in the given order."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("newest"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"newest.{c}").alias(c) for c in rows.columns])


def to_create(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, one per key."""
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    return first_written(fresh, keys)


def get_or_create(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after registration; rows that existed are unchanged."""
    return existing.unionByName(to_create(existing, incoming, keys))


def pipeline_by_name(pipelines: DataFrame, name: str) -> DataFrame:
    return pipelines.where(F.col("name") == name)


def dataset_by_name(datasets: DataFrame, name: str, pipeline: str | None = None) -> DataFrame:
    """The dataset of a pipeline, or the first registered one of that name."""
    found = datasets.where(F.col("name") == name)
    if pipeline is not None:
        return found.where(F.col("pipeline") == pipeline)
    return found.orderBy("seq", "pipeline").limit(1)


def first_datasets(datasets: DataFrame) -> DataFrame:
    """For every dataset name, the first one registered under it."""
    return first_written(datasets, ["name"])


def latest_contracts(contracts: DataFrame) -> DataFrame:
    """The highest version of every dataset's contract."""
    return newest_rows(contracts, ["pipeline", "dataset"], ["version"])


def contract_by_version(contracts: DataFrame, pipeline: str, dataset: str, version: int) -> DataFrame:
    return contracts.where(
        (F.col("pipeline") == pipeline) & (F.col("dataset") == dataset) & (F.col("version") == version)
    )


def contract_summaries(contracts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Latest version, column names in order, freshness limit and quality rules."""
    rule: Column = F.from_json("schema_definition", SCHEMA_MAP)
    roles = datasets.select("pipeline", F.col("name").alias("dataset"), "role")
    return (
        latest_contracts(contracts)
        .join(roles, ["pipeline", "dataset"])
        .select(
            "pipeline",
            F.col("dataset").alias("dataset_name"),
            "role",
            F.col("version").alias("contract_version"),
            F.map_keys(rule).alias("schema_columns"),
            F.get_json_object("freshness", "$.max_age_hours")
            .try_cast("double")
            .alias("freshness_max_age_hours"),
            "quality_rules",
        )
    )
