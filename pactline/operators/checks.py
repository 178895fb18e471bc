"""The five contract checks.

Each verdict is an expression over the one-row measures of a dataset, so a run
is a single lazy DataFrame with one row per check.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline import model
from pactline.functions import timestamps
from pactline.functions.text import column, document, quoted_list, two_decimals
from pactline.functions.validators import is_known
from pactline.operators.measures import checked_columns, duplicate_rows, measure, same_keys
from pactline.sources.contracts import Contract
from pactline.sources.resolve import Resolved

def _none() -> Column:
    return F.lit(None).cast("string")


def _verdict(
    check_type: str,
    failed: Column,
    expected: Column,
    observed: Column,
    message: Column,
    category: Column,
) -> Column:
    return F.struct(
        F.lit(model.CHECK_ORDER.index(check_type) + 1).alias("check_order"),
        F.lit(check_type).alias("check_type"),
        F.when(failed, model.FAILED).otherwise(model.PASSED).alias("status"),
        expected.alias("expected"),
        observed.alias("observed"),
        message.alias("message"),
        F.when(failed, category).alias("error_category"),
    )


def _skipped(check_type: str, message: str) -> Column:
    return F.struct(
        F.lit(model.CHECK_ORDER.index(check_type) + 1).alias("check_order"),
        F.lit(check_type).alias("check_type"),
        F.lit(model.SKIPPED).alias("status"),
        _none().alias("expected"),
        _none().alias("observed"),
        F.lit(message).alias("message"),
        _none().alias("error_category"),
    )


def _unreadable(check_type: str, error: str, expected: Column, observed: Column, message: str) -> Column:
    found = "not found" in error.lower()
    category = F.lit("source_not_found" if found else "source_not_readable")
    return _verdict(check_type, F.lit(True), expected, observed, F.lit(message), category)


def _rows_of(measures: DataFrame, verdicts: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    return measures.select(*keep, F.inline(F.array(*verdicts)))


def _one_row() -> DataFrame:
    return SparkSession.active().range(1)


# -- readability -----------------------------------------------------------


def _readability(source: Resolved) -> Column:
    kind = model.SOURCE_READABILITY
    if not source.readable:
        return _unreadable(
            kind,
            source.error,
            document(parseable=True),
            document(parseable=False, error=source.error),
            f"Source not readable: {source.error}",
        )
    rows = F.col("row_count")
    empty = rows == 0
    width = F.lit(source.column_count)
    return _verdict(
        kind,
        empty,
        F.when(empty, document(row_count="> 0")).otherwise(
            document(parseable=True, row_count="> 0")
        ),
        F.when(empty, document(row_count=0)).otherwise(
            document(parseable=True, row_count=rows, columns=source.column_count)
        ),
        F.when(empty, "Source has 0 rows").otherwise(
            F.format_string("Source readable: %d rows, %d columns", rows, width)
        ),
        F.lit("source_not_readable"),
    )


# -- schema ----------------------------------------------------------------


def _at_row(first: Column) -> Column:
    row = first["row"]
    return F.when(row.isNull(), "").otherwise(F.format_string(" at row %d", row))


def _named(texts: list[str], first: Column) -> Column:
    """The text that belongs to the violating column."""
    return F.get(F.from_json(F.lit(json.dumps(texts)), "array<string>"), first["position"])


def observed_columns(source: Resolved, contract: Contract) -> list[str]:
    """Columns of the data; partition folders count when the contract names them."""
    named = set(contract.column_names)
    return list(source.columns) + [c for c in source.partition_columns if c in named]


def _schema(
    source: Resolved,
    contract: Contract,
    check_type: str,
    rule_set: str,
    stats: str | None = None,
    samples: bool = True,
) -> Column:
    expected_names = sorted(contract.column_names)
    expected = document(columns=expected_names, column_count=len(expected_names))
    if not source.readable:
        return _unreadable(
            check_type,
            source.error,
            expected,
            document(columns=[], column_count=0, error=source.error),
            f"Cannot read source for schema check: {source.error}",
        )

    def stat(name: str) -> Column:
        return F.col(f"{stats}.{name}" if stats else name)

    observed_names = sorted(set(observed_columns(source, contract)))
    missing = sorted(set(expected_names) - set(observed_names))
    unexpected = sorted(set(observed_names) - set(expected_names))
    nulls, types = stat("null_violations"), stat("type_violations")
    failed = F.lit(bool(missing or unexpected)) | (nulls > 0) | (types > 0)

    checked = checked_columns(source.frame, contract, rule_set)
    null_case = type_case = F.lit("")
    if samples:
        null, bad = stat("first_null"), stat("first_type")
        null_case = F.concat(
            _named([f": Null in non-nullable column '{c.rule.name}'" for c in checked], null), _at_row(null)
        )
        type_case = F.concat(
            _named([f": Type mismatch in '{c.rule.name}'" for c in checked], bad),
            _at_row(bad),
            _named([f": expected {c.rule.type}, got '" for c in checked], bad),
            F.coalesce(bad["value"], F.lit("")),
            F.lit("'"),
        )
    problems = F.concat_ws(
        "; ",
        F.lit(f"Missing columns: {quoted_list(missing)}") if missing else _none(),
        F.lit(f"Unexpected columns: {quoted_list(unexpected)}") if unexpected else _none(),
        F.when(nulls > 0, F.concat(F.format_string("Null violations (%d)", nulls), null_case)),
        F.when(types > 0, F.concat(F.format_string("Type violations (%d)", types), type_case)),
    )
    shape = {"columns": observed_names, "column_count": len(observed_names)}
    unchecked = sorted(
        r.name for r in contract.columns
        if r.name in observed_names and not is_known(r.type, rule_set)
    )
    if unchecked:
        shape["unchecked_columns"] = unchecked
    kinds = [bool(missing), bool(unexpected)]
    single = (
        F.when(F.lit(kinds == [True, False]) & (nulls == 0) & (types == 0), "schema_missing_columns")
        .when(F.lit(kinds == [False, True]) & (nulls == 0) & (types == 0), "schema_unexpected_columns")
        .when(F.lit(kinds == [False, False]) & (nulls == 0) & (types > 0), "schema_type_violation")
        .otherwise("schema_mismatch")
    )
    return _verdict(
        check_type,
        failed,
        expected,
        F.when(
            failed, document(**shape, missing=missing, unexpected=unexpected)
        ).otherwise(document(**shape)),
        F.when(failed, problems).otherwise(
            F.lit(f"Schema matches: {len(observed_names)} columns as expected")
        ),
        single,
    )


# -- row count -------------------------------------------------------------


def _row_count(source: Resolved, contract: Contract, target: Resolved | None) -> Column:
    kind = model.ROW_COUNT
    low, high = contract.min_row_count, contract.max_row_count
    high_text = "inf" if high is None else str(high)
    keys = list(contract.unique_keys)
    if not source.readable:
        return _unreadable(
            kind,
            source.error,
            document(min_row_count=low, max_row_count=high),
            document(source_row_count=0, error=source.error),
            f"Cannot read source for row count: {source.error}",
        )
    rows = F.col("row_count")
    outside = rows < low
    if high is not None:
        outside = outside | (rows > high)
    range_text = f"[{low}, {high_text}]"
    problems = [
        F.when(outside, F.concat(F.format_string("Source row count %d outside range ", rows), F.lit(range_text)))
    ]
    failed = outside
    observed = {"source_row_count": rows, "target_row_count": F.lit(None).cast("bigint")}
    duplicated = F.lit(False)
    if keys:
        duplicates = F.col("duplicates")
        duplicated = duplicates > 0
        problems.append(
            F.when(
                duplicated,
                F.concat(
                    F.format_string("Found %d duplicate rows on keys ", duplicates), F.lit(quoted_list(keys))
                ),
            )
        )
        failed = failed | duplicated
    if target is not None and not target.readable:
        problems.append(F.lit(f"Target not readable: {target.error}"))
        failed = F.lit(True)
    elif target is not None:
        copied = F.col("target.row_count")
        observed["target_row_count"] = copied
        apart = difference_pct(rows, copied)
        limit = contract.max_row_count_diff_pct
        mismatch = apart > F.lit(float(limit))
        problems.append(
            F.when(
                mismatch,
                F.concat(
                    F.format_string("Source-target mismatch: %d vs %d (", rows, copied),
                    # An empty source gives the whole-number 100.
                    F.when(rows == 0, F.lit("100")).otherwise(two_decimals(apart)),
                    F.lit(f"% diff, max {limit}%)"),
                ),
            )
        )
        failed = failed | mismatch
    if keys:
        observed["duplicate_count"] = F.col("duplicates")
    shown = document(**observed)
    if keys:
        # No keys are counted when there are no rows.
        bare = {k: v for k, v in observed.items() if k != "duplicate_count"}
        shown = F.when(rows == 0, document(**bare)).otherwise(shown)
    return _verdict(
        kind,
        failed,
        document(min_row_count=low, max_row_count=high, unique_keys=keys),
        shown,
        F.when(failed, F.concat_ws("; ", *problems)).otherwise(
            F.concat(F.format_string("Row count %d within range ", rows), F.lit(range_text))
        ),
        F.when(outside, "row_count_out_of_range").when(duplicated, "duplicate_keys").otherwise("unknown"),
    )


def difference_pct(source_rows: Column, target_rows: Column) -> Column:
    """Row-count difference in percent of the source; an empty source is 0 or 100."""
    return (
        F.when(source_rows > 0, F.abs(source_rows - target_rows) / source_rows * 100)
        .when(target_rows == 0, F.lit(0.0))
        .otherwise(F.lit(100.0))
    )


# -- freshness -------------------------------------------------------------


def _freshness(source: Resolved, contract: Contract, as_of: datetime) -> Column:
    kind = model.FRESHNESS
    limit, stamp = contract.max_age_hours, contract.timestamp_column
    expected = document(max_age_hours=limit, timestamp_column=stamp)
    if not source.readable:
        return _unreadable(
            kind,
            source.error,
            expected,
            document(latest_timestamp=None, error=source.error),
            f"Cannot read source for freshness: {source.error}",
        )
    rows, newest = F.col("row_count"), F.col("latest")
    age = age_hours(newest, as_of)
    stale = age > F.lit(float(limit))
    shown = two_decimals(age)

    def sentence(word: str) -> Column:
        return F.concat(F.lit(f"Data is {word}: "), shown, F.lit(f"h old (max {limit}h)"))

    return _verdict(
        kind,
        (rows == 0) | newest.isNull() | stale,
        expected,
        F.when(rows == 0, document(latest_timestamp=None, row_count=0))
        .when(newest.isNull(), document(latest_timestamp=None, parseable_timestamps=0))
        .otherwise(
            document(latest_timestamp=timestamps.iso_utc(newest), age_hours=F.round(age, 2))
        ),
        F.when(rows == 0, "No rows to evaluate freshness")
        .when(newest.isNull(), f"No valid timestamps found in column '{stamp}'")
        .when(stale, sentence("stale"))
        .otherwise(sentence("fresh")),
        F.lit("freshness_exceeded"),
    )


def age_hours(latest: Column, as_of: datetime) -> Column:
    """Age in hours, unrounded; event times after ``as_of`` are negative."""
    micros = F.lit(timestamps.micros_of(as_of)).cast("bigint") - latest
    return micros / F.lit(float(timestamps.HOUR_MICROS))


# -- public ----------------------------------------------------------------


def check_readability(source: Resolved) -> DataFrame:
    if not source.readable:
        return _rows_of(_one_row(), [_readability(source)])
    return _rows_of(source.frame.agg(F.count(F.lit(1)).alias("row_count")), [_readability(source)])


def check_schema(
    source: Resolved,
    contract: Contract,
    rule_set: str = "reference",
    check_type: str = model.SCHEMA_COMPATIBILITY,
) -> DataFrame:
    verdict = _schema(source, contract, check_type, rule_set)
    if not source.readable:
        return _rows_of(_one_row(), [verdict])
    return _rows_of(measure(source, contract, freshness=False, rule_set=rule_set), [verdict])


def check_target_schema(
    target: Resolved | None, contract: Contract | None, rule_set: str = "reference"
) -> DataFrame:
    """The schema check on a target; skipped without a target or without its contract."""
    kind = model.TARGET_SCHEMA_COMPATIBILITY
    if target is None or contract is None:
        return _rows_of(_one_row(), [_skipped(kind, "No target to validate")])
    return check_schema(target, contract, rule_set, kind)


def _with_counts(
    measures: DataFrame,
    source: Resolved,
    contract: Contract,
    target: Resolved | None,
    target_measures: DataFrame | None = None,
) -> DataFrame:
    """Add the duplicate count and the target's measures as scalar subqueries."""
    extra: list[Column] = []
    if contract.unique_keys:
        extra.append(duplicate_rows(source.frame, contract.unique_keys).scalar().alias("duplicates"))
    if target is not None and target.readable:
        if target_measures is None:
            target_measures = target.frame.agg(F.count(F.lit(1)).alias("row_count"))
        one = target_measures.select(F.struct("*").alias("target"))
        extra.append(one.scalar().alias("target"))
    return measures.select("*", *extra) if extra else measures


def check_row_count(source: Resolved, contract: Contract, target: Resolved | None = None) -> DataFrame:
    verdict = _row_count(source, contract, target)
    if not source.readable:
        return _rows_of(_one_row(), [verdict])
    measures = source.frame.agg(F.count(F.lit(1)).alias("row_count"))
    return _rows_of(_with_counts(measures, source, contract, target), [verdict])


def check_freshness(source: Resolved, contract: Contract, as_of: datetime) -> DataFrame:
    verdict = _freshness(source, contract, as_of)
    if not source.readable:
        return _rows_of(_one_row(), [verdict])
    return _rows_of(measure(source, contract, schema=False, samples=False), [verdict])


def contract_checks(
    source: Resolved,
    contract: Contract,
    as_of: datetime,
    target: Resolved | None = None,
    target_contract: Contract | None = None,
    rule_set: str = "reference",
) -> DataFrame:
    """All checks of a run, in order, as one DataFrame.

    One pass over the source, one over its key columns, one over the target.
    A dataset that cannot be read, or has no rows, ends after the first check.
    """
    if not source.readable:
        return _rows_of(_one_row(), [_readability(source)])
    target_kind = model.TARGET_SCHEMA_COMPATIBILITY
    target_measures = None
    target_verdict = _skipped(target_kind, "No target to validate")
    if target is not None and target_contract is not None:
        if target.readable:
            target_measures = measure(target, target_contract, freshness=False, rule_set=rule_set)
        target_verdict = _schema(target, target_contract, target_kind, rule_set, "target")
    measures = _with_counts(
        measure(source, contract, rule_set=rule_set), source, contract, target, target_measures
    )
    verdicts = [
        _readability(source),
        _schema(source, contract, model.SCHEMA_COMPATIBILITY, rule_set),
        target_verdict,
        _row_count(source, contract, target),
        _freshness(source, contract, as_of),
    ]
    return _stop_after_empty(_rows_of(measures, verdicts, ["row_count"]))


def _stop_after_empty(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("row_count") > 0) | (F.col("check_order") == 1)).drop("row_count")


def _whole(measures: DataFrame, by: Sequence[str], fields: Sequence[str]) -> Column:
    """The measures as one struct, with zero for the counts of a dataset that is not there."""
    counts = ("row_count", "null_violations", "type_violations")
    present = {c: F.coalesce(measures[c], F.lit(0)) if c in counts else measures[c] for c in fields}
    return F.struct(*[v.alias(c) for c, v in present.items()])


def _with_target(measures: DataFrame, target: DataFrame, by: Sequence[str], target_by: Sequence[str]) -> DataFrame:
    """Measures of source and target per key, from either side's keys, null equal to null."""
    own = [c for c in measures.columns if c not in by]
    fields = [c for c in target.columns if c not in target_by]
    joined = measures.join(target, same_keys(measures, target, by, target_by), "full_outer")
    counts = ("row_count", "null_violations", "type_violations", "duplicates")
    return joined.select(
        *[F.coalesce(measures[f"`{k}`"], target[f"`{t}`"]).alias(k) for k, t in zip(by, target_by)],
        *[(F.coalesce(measures[c], F.lit(0)) if c in counts else measures[c]).alias(c) for c in own],
        _whole(target, target_by, fields).alias("target"),
    )


def contract_checks_by_key(
    source: Resolved,
    contract: Contract,
    as_of: datetime,
    by: Sequence[str],
    rule_set: str = "reference",
    *,
    target: Resolved | None = None,
    target_contract: Contract | None = None,
    target_by: Sequence[str] | None = None,
    samples: bool = False,
) -> DataFrame:
    """All checks for every key of a table that holds many datasets, with the keys of a target table beside it.

    ``target_by`` names the target's key columns where they differ. A key that only the
    target has is a source without rows, one that only the source has a target without
    rows. With ``samples`` messages name the first violation: lowest column, lowest value.

    Two shuffles for the source whatever the number of datasets, partial sums per key and
    partial counts per key and unique key, and one for the target; with samples one more
    for what breaks a type rule on each side. No dataset is gathered in one task: what is
    joined are the measures, one row per key.
    """
    by = list(by)
    if not source.readable:
        return _rows_of(_one_row(), [_readability(source)])
    measures = measure(source, contract, by=by, samples=samples, rule_set=rule_set)
    if contract.unique_keys:
        duplicates = duplicate_rows(source.frame, contract.unique_keys, by)
        measures = measures.join(duplicates, same_keys(measures, duplicates, by), "inner").select(
            *[measures[f"`{c}`"] for c in measures.columns], "duplicates"
        )
    target_kind = model.TARGET_SCHEMA_COMPATIBILITY
    target_verdict = _skipped(target_kind, "No target to validate")
    if target is not None and target.readable:
        target_by = list(target_by or by)
        if target_contract is not None:
            other = measure(target, target_contract, by=target_by, freshness=False, samples=samples, rule_set=rule_set)
        else:
            other = target.frame.groupBy(*[column(k) for k in target_by]).agg(F.count(F.lit(1)).alias("row_count"))
        measures = _with_target(measures, other, by, target_by)
    if target is not None and target_contract is not None:
        target_verdict = _schema(target, target_contract, target_kind, rule_set, "target", samples)
    verdicts = [
        _readability(source),
        _schema(source, contract, model.SCHEMA_COMPATIBILITY, rule_set, samples=samples),
        target_verdict,
        _row_count(source, contract, target),
        _freshness(source, contract, as_of),
    ]
    return _stop_after_empty(_rows_of(measures, verdicts, [*by, "row_count"]))
