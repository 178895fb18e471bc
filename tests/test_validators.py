"""Validators against a plain restatement of the rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline.functions import validators


def is_number(text):
    try:
        float(text)
    except ValueError:
        return False
    return True


def is_date_shape(text):
    parts = text.split("-")
    return [len(p) for p in parts] == [4, 2, 2] and all(p.isdigit() for p in parts)


RULES = {
    "string": lambda v: len(v) > 0,
    "integer": str.isdigit,
    "decimal": is_number,
    "date": is_date_shape,
    "timestamp": is_date_shape,
}
VALUES = [
    "1", "007", "-1", "+1", "1.0", "abc", "3\n", " 3", "٣", "²", "1²", "①", "", "1_000", "1__0", "_1", "1_",
    "1e5", "1E-5", "1e", ".5", "5.", ".", "1_0.0_1e1_0", "inf", "-Infinity", "NaN", "+nan", "infin", "1d", "0x1",
    " 7 ", " 7　", "\x1c7", "​7", "2026-07-27", "2026-13-45", "2026-7-27", "2026-07-27\n",
    "2026-07-27 10:00", "2026-07-27T10:00:00", "٢٠٢٦-٠٧-٢٧", "2026/07/27", "20260727", "--", "1" * 20000,
    "1_" * 9000 + "1", " " * 9000 + "1", "1." + "0" * 9000 + "x",
]


def spark_says(spark, values, kind, rule_set="reference"):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rule = validators.RULE_SETS[rule_set][kind]
    return [r["ok"] for r in frame.select("i", rule(F.col("v")).alias("ok")).orderBy("i").collect()]


@pytest.mark.parametrize("kind", sorted(RULES))
def test_listed_values(spark, kind):
    assert spark_says(spark, VALUES, kind) == [RULES[kind](v) for v in VALUES]


near_number = st.text(alphabet="0123456789_.+-eEinfa \n ٣²", max_size=8)
near_date = st.from_regex(r"\A[0-9]{3,5}-[0-9]{1,3}-[0-9]{1,3}\n?\Z")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(near_number, near_date), min_size=40, max_size=120))
def test_random_values(spark, values):
    for kind in ("integer", "decimal", "date"):
        assert spark_says(spark, values, kind) == [RULES[kind](v) for v in values]


def test_typed_rules(spark):
    values = ["-5", "2026-13-45", "2026-12-31", "2026-07-27T10:00:00", "2026", "5.0"]
    assert spark_says(spark, values, "integer", "typed") == [True, False, False, False, True, False]
    assert spark_says(spark, values, "date", "typed") == [False, False, True, False, False, False]
    assert spark_says(spark, values, "timestamp", "typed") == [False, False, True, True, False, False]


@pytest.mark.parametrize(
    "data_type, contract_type, judged",
    [
        (T.LongType(), "integer", "valid"),
        (T.BooleanType(), "integer", "valid"),
        (T.DoubleType(), "integer", "wrong"),
        (T.DecimalType(10, 2), "decimal", "valid"),
        (T.LongType(), "string", "wrong"),
        (T.TimestampNTZType(), "timestamp", "valid"),
        (T.DateType(), "date", "valid"),
        (T.StringType(), "string", "valid"),
    ],
)
def test_typed_columns_are_judged_by_schema(data_type, contract_type, judged):
    rule = validators.is_violation("c", data_type, contract_type)
    assert (rule is None) == (judged == "valid")


def test_registering_a_type(spark):
    validators.register_validator("flag", lambda c: c.isin("true", "false"), (T.BooleanType,))
    try:
        assert validators.is_known("flag")
        assert spark_says(spark, ["true", "yes"], "flag") == [True, False]
    finally:
        validators.REFERENCE_RULES.pop("flag")
        validators.TYPED_ACCEPTS.pop("flag")
