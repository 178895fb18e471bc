"""What a dataset looks like, measured once.

All row-level rules of a contract fold into a fixed handful of aggregates,
however many columns it has: counts of violations, the first violation of each
kind, the row count and the latest event time. One scan, one row per partition
over the wire.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactline.functions import timestamps, validators
from pactline.functions.text import column, quoted
from pactline.sources.contracts import ColumnRule, Contract
from pactline.sources.delimited import BLOCK, ROW
from pactline.sources.resolve import Resolved


@dataclass(frozen=True)
class CheckedColumn:
    rule: ColumnRule
    missing: Column | None
    violation: Column | None


def checked_columns(
    frame: DataFrame, contract: Contract, rule_set: str = "reference"
) -> list[CheckedColumn]:
    """Contract columns present in the frame whose type has a validator, by name.

    A type without a validator leaves its column unchecked, nulls included.
    """
    fields = {f.name: f.dataType for f in frame.schema.fields}
    found = []
    for rule in sorted(contract.columns, key=lambda r: r.name):
        if rule.name not in fields or not validators.is_known(rule.type, rule_set):
            continue
        kind = fields[rule.name]
        found.append(
            CheckedColumn(
                rule,
                None if rule.nullable else validators.is_missing(rule.name, kind),
                validators.is_violation(rule.name, kind, rule.type, rule_set),
            )
        )
    return found


def _hits(flags: Sequence[str]) -> str:
    """Number of violations in the dataset."""
    if not flags:
        return "0L"
    per_row = " + ".join(f"CASE WHEN {f} THEN 1 ELSE 0 END" for f in flags)
    return f"coalesce(sum({per_row}), 0L)"


def _first(hits: Sequence[tuple[int, str, str]]) -> str:
    """First violation: lowest column, then lowest row, then lowest value.

    Taking the lowest violating column of each row is enough, since no row has
    a violation below the lowest column of the whole dataset.
    """
    if not hits:
        return "CAST(NULL AS struct<position: int, block: bigint, row: bigint, value: string>)"
    cases = ", ".join(
        f"""CASE WHEN {flag} THEN named_struct(
          'position', {i}, 'block', __block, 'row', __row, 'value', string({quoted(name)})) END"""
        for i, flag, name in hits
    )
    return f"min(coalesce({cases}))"


def _lowest(hits: Sequence[tuple[int, str, str]]) -> str:
    """Position of the lowest column with a violation."""
    return f"min(coalesce({', '.join(f'CASE WHEN {flag} THEN {i} END' for i, flag, _ in hits)}))" if hits else "CAST(NULL AS int)"


def same_keys(left: DataFrame, right: DataFrame, by: Sequence[str], right_by: Sequence[str] = ()) -> Column:
    """Equal keys, null equal to null."""
    pairs = [left[f"`{k}`"].eqNullSafe(right[f"`{r}`"]) for k, r in zip(by, right_by or by)]
    return reduce(lambda x, y: x & y, pairs)


def with_first_cases(measures: DataFrame, source: Resolved, contract: Contract, by: Sequence[str], rule_set: str) -> DataFrame:
    """The measures per key with first_null and first_type: lowest column, then lowest value.

    Rows of a table have no numbers. Only rows that break a type rule are looked at
    again, reduced to one per key in each task, so a key that holds most of them is no hot spot.
    """
    checked = checked_columns(source.frame, contract, rule_set)
    bad = [
        F.when(c.violation, F.struct(F.lit(i).alias("position"), column(c.rule.name).cast("string").alias("value")))
        for i, c in enumerate(checked) if c.violation is not None
    ]
    none = F.lit(None).cast("struct<position: int, block: bigint, row: bigint, value: string>")
    case = lambda position, value: F.struct(
        position.alias("position"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("row"), value.alias("value")
    )
    null = F.when(F.col("null_position").isNotNull(), case(F.col("null_position"), F.lit(None).cast("string")))
    measures = measures.withColumn("first_null", null).drop("null_position")
    if not bad:
        return measures.withColumn("first_type", none)
    rows = source.frame.select(*[column(k).alias(f"__by{i}") for i, k in enumerate(by)], F.coalesce(*bad).alias("case"))
    names = [f"__by{i}" for i in range(len(by))]
    first = rows.where("case IS NOT NULL").groupBy(*names).agg(F.min("case").alias("case"))
    joined = measures.join(first, same_keys(measures, first, by, names), "left")
    found = F.when(F.col("case").isNotNull(), case(F.col("case.position"), F.col("case.value")))
    return joined.withColumn("first_type", found).drop("case", *names)


def measure(
    source: Resolved,
    contract: Contract,
    *,
    by: Sequence[str] = (),
    schema: bool = True,
    freshness: bool = True,
    samples: bool = True,
    rule_set: str = "reference",
) -> DataFrame:
    """row_count, null/type violations with their first cases, latest event time.

    One row for the dataset, or one per key when ``by`` names key columns; the first
    cases then come from a second pass over the rows that break a type rule.
    """
    if by and samples:
        plain = measure(source, contract, by=by, schema=schema, freshness=freshness, samples=False, rule_set=rule_set)
        return with_first_cases(plain, source, contract, by, rule_set) if schema else plain
    numbered = samples and not by and source.placed is not None
    frame = source.placed if numbered else source.frame
    checked = checked_columns(frame, contract, rule_set) if schema else []
    nulls = [(i, f"__null{i}", c.rule.name) for i, c in enumerate(checked) if c.missing is not None]
    types = [(i, f"__type{i}", c.rule.name) for i, c in enumerate(checked) if c.violation is not None]
    # The rules are columns of their own, so each is evaluated once for the
    # count and for the first case.
    flags = [checked[i].missing.alias(flag) for i, flag, _ in nulls]
    flags += [checked[i].violation.alias(flag) for i, flag, _ in types]

    kinds = {f.name: f.dataType for f in frame.schema.fields}
    stamp = contract.timestamp_column
    timed = freshness and stamp in kinds

    needed = {name for _, _, name in nulls + types} if samples else set()
    needed.update(by)
    if timed:
        needed.add(stamp)
    if samples:
        flags += _place(source, numbered)
    rows = frame.select(*flags, *[column(n) for n in sorted(needed)])

    aggregates = [
        "count(1) AS row_count",
        f"{_hits([flag for _, flag, _ in nulls])} AS null_violations",
        f"{_hits([flag for _, flag, _ in types])} AS type_violations",
    ]
    if by:
        # A number, so that all keys are folded by hashing.
        aggregates.append(f"{_lowest(nulls)} AS null_position")
    if samples:
        aggregates += [f"{_first(nulls)} AS first_null", f"{_first(types)} AS first_type"]
    computed = [F.expr(text) for text in aggregates]
    if timed:
        computed.append(timestamps.latest(stamp, kinds[stamp]).alias("latest"))
    if numbered:
        result = _over_blocks(rows.groupBy(BLOCK).agg(*computed, F.min(ROW).alias("base")))
    else:
        result = (rows.groupBy(*[column(k) for k in by]) if by else rows).agg(*computed)
    latest = timestamps.latest_micros(F.col("latest"), kinds[stamp]) if timed else F.lit(None).cast("bigint")
    return result.withColumn("latest", latest)


def _place(source: Resolved, numbered: bool) -> list[Column]:
    """Where a row stands: its number, or its block and an id that grows with the rows."""
    if numbered:
        return [F.col(BLOCK), F.col(ROW)]
    row = F.lit(None) if source.row_number is None else source.row_number
    return [F.lit(None).cast("bigint").alias(BLOCK), row.cast("bigint").alias(ROW)]


def _over_blocks(blocks: DataFrame) -> DataFrame:
    """The measures of a file from those of its blocks, one row per split of the scan.

    The rows before a block turn places inside it into row numbers of the file.
    """
    before = F.coalesce(F.sum("row_count").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = ("first_null", "first_type")
    placed = blocks.withColumn("before", before).withColumns(
        {
            f: F.when(
                F.col(f).isNotNull(),
                F.struct(
                    F.col(f)["position"].alias("position"), F.col(f)["block"].alias("block"),
                    (F.col("before") + F.col(f)["row"] - F.col("base") + 1).alias("row"), F.col(f)["value"].alias("value"),
                ),
            )
            for f in firsts
        }
    )
    folds = {"row_count": F.sum, "null_violations": F.sum, "type_violations": F.sum, "first_null": F.min, "first_type": F.min, "latest": F.max}
    folded = [fold(name) for name, fold in folds.items() if name in blocks.columns]
    names = [name for name in folds if name in blocks.columns]
    sums = {"row_count", "null_violations", "type_violations"}
    return placed.agg(*[(F.coalesce(x, F.lit(0)) if n in sums else x).alias(n) for n, x in zip(names, folded)])


def key_columns(frame: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Key values under neutral names; a column the dataset lacks reads as empty text."""
    return [
        (column(k) if k in frame.columns else F.lit("")).alias(f"__key{i}")
        for i, k in enumerate(keys)
    ]


def duplicate_rows(frame: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each key; null keys equal each other.

    Only the key columns are read. Partial counts are made before the shuffle,
    so a key that holds much of the data arrives as one row per task.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    extra = F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates")
    counted = frame.select(*[column(k) for k in by], *key_columns(frame, keys)).groupBy(*by, *names).count()
    return counted.groupBy(*by).agg(extra) if by else counted.agg(extra)


def column_violations(source: Resolved, contract: Contract, rule_set: str = "reference") -> DataFrame:
    """One row per checked column: its type and the counts of null and type violations."""
    checked = checked_columns(source.frame, contract, rule_set)
    never = F.lit(False)
    counts = [
        F.array(
            F.count_if(c.missing if c.missing is not None else never),
            F.count_if(c.violation if c.violation is not None else never),
        ).alias(f"c{i}")
        for i, c in enumerate(checked)
    ]
    entries = [
        F.struct(
            F.lit(c.rule.name).alias("column"),
            F.lit(c.rule.type).alias("type"),
            F.col(f"c{i}")[0].alias("null_violations"),
            F.col(f"c{i}")[1].alias("type_violations"),
        )
        for i, c in enumerate(checked)
    ]
    return source.frame.agg(*counts).select(F.inline(F.array(*entries)))


def column_drift(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Columns on one side only, for any number of datasets.

    Both inputs have ``dataset`` and ``column``. A column that only the
    contract has is missing, one that only the data has is unexpected.
    """
    keys = ["dataset", "column"]
    missing = expected.select(*keys).join(observed.select(*keys), keys, "left_anti")
    unexpected = observed.select(*keys).join(expected.select(*keys), keys, "left_anti")
    return missing.withColumn("drift", F.lit("missing")).unionByName(
        unexpected.withColumn("drift", F.lit("unexpected"))
    )


def latest_by_key(frame: DataFrame, key: str, timestamp_column: str) -> DataFrame:
    """Row count and latest event time of every key."""
    kind = frame.schema[timestamp_column].dataType
    return (
        frame.groupBy(column(key))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            timestamps.latest(timestamp_column, kind).alias("latest"),
        )
        .withColumn("latest", timestamps.latest_micros(F.col("latest"), kind))
    )
