"""Type validators: contract type name -> expression over a column.

Two rule sets exist. ``reference`` accepts what the contract model defines for
text (unsigned digits for integers, the shape of a date); ``typed`` asks for
values that cast to the type. A column that already has a Spark type is judged
by its schema, so no row needs to be looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline.functions.text import quoted

Validator = Callable[[Column], Column]

# Characters with a Unicode digit value outside category Nd.
EXTRA_DIGITS = (
    r"\x{00B2}-\x{00B3}\x{00B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
DIGIT = rf"[\p{{Nd}}{EXTRA_DIGITS}]"

# Characters that count as white space around a number.
SPACE = (
    r"[\x09-\x0D\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]"
)

# Possessive repeats keep the matcher flat on very long values.
_DIGITS = r"\p{Nd}++(?:_\p{Nd}++)*+"
INTEGER_PATTERN = rf"\A{DIGIT}++\z"
DATE_PATTERN = rf"\A{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}\z"
DECIMAL_PATTERN = (
    rf"\A{SPACE}*+[+-]?(?:(?i:inf(?:inity)?|nan)|"
    rf"(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?){SPACE}*+\z"
)
SIGNED_PATTERN = r"\A[+-]?[0-9]++\z"

REFERENCE_RULES: dict[str, Validator] = {
    "string": lambda c: F.length(c) > 0,
    "integer": lambda c: c.rlike(INTEGER_PATTERN),
    "decimal": lambda c: c.rlike(DECIMAL_PATTERN),
    "date": lambda c: c.rlike(DATE_PATTERN),
    "timestamp": lambda c: c.rlike(DATE_PATTERN),
}

TYPED_RULES: dict[str, Validator] = {
    "string": lambda c: F.length(c) > 0,
    "integer": lambda c: c.rlike(SIGNED_PATTERN),
    "decimal": lambda c: c.rlike(DECIMAL_PATTERN),
    "date": lambda c: c.rlike(DATE_PATTERN) & c.try_cast("date").isNotNull(),
    "timestamp": lambda c: (F.length(c) >= 10) & c.try_cast("timestamp").isNotNull(),
}

RULE_SETS = {"reference": REFERENCE_RULES, "typed": TYPED_RULES}

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_NUMBER = _WHOLE + (T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
TYPED_ACCEPTS: dict[str, tuple[type, ...]] = {
    "string": (T.StringType,),
    "integer": _WHOLE,
    "decimal": _NUMBER,
    "date": _TIME,
    "timestamp": _TIME,
}


def register_validator(
    name: str, rule: Validator, accepts: tuple[type, ...] = (), rule_set: str = "reference"
) -> None:
    """Add a contract type, or replace one."""
    RULE_SETS[rule_set][name] = rule
    TYPED_ACCEPTS[name] = accepts


def is_known(contract_type: str, rule_set: str = "reference") -> bool:
    return contract_type in RULE_SETS[rule_set]


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_missing(name: str, data_type: T.DataType) -> Column:
    """Null, or the empty text."""
    value = quoted(name)
    return F.expr(f"{value} IS NULL OR {value} = ''" if is_text(data_type) else f"{value} IS NULL")


def is_violation(
    name: str, data_type: T.DataType, contract_type: str, rule_set: str = "reference"
) -> Column | None:
    """A present value that breaks the type; None when the schema rules it out."""
    value = quoted(name)
    if is_text(data_type):
        if contract_type == "string":
            return None
        return F.expr(f"{value} <> ''") & ~RULE_SETS[rule_set][contract_type](F.col(value))
    if isinstance(data_type, TYPED_ACCEPTS.get(contract_type, ())):
        return None
    return F.expr(f"{value} IS NOT NULL")
