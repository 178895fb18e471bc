"""Names, messages and JSON text."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def quoted(name: str) -> str:
    """A column name as it is written in SQL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def two_decimals(number: Column) -> Column:
    """A number rounded to two decimals, with at least one decimal shown."""
    return F.regexp_replace(F.format_string("%.2f", number.cast("double")), "0$", "")


def quoted_list(names: Iterable[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def run_id(moment: Column, seed: Column) -> Column:
    """Run id of a day and six hexadecimal digits; the same seed gives the same id."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd"), F.lit("-"), F.substring(F.md5(seed), 1, 6))


def document(**fields: Any) -> Column:
    """JSON text of named values, nulls included; plain values need no expression."""
    if not any(isinstance(v, Column) for v in fields.values()):
        return F.lit(json.dumps(fields, separators=(",", ":"), ensure_ascii=False))
    columns = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]
    return F.to_json(F.struct(*columns), KEEP_NULLS)
