"""Event times as microseconds since the epoch, independent of the session zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline.functions.text import column, quoted
from pactline.functions.validators import is_text

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000

# The shapes of ISO 8601 text that count as an event time.
DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
USUAL_SHAPE = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?"
    r"(?:Z|[+-](?:0[0-9]|1[0-7]):[0-5][0-9])?\z"
)
_DAY = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{4}-W[0-9]{2}(?:-[0-9])?|[0-9]{4}W[0-9]{2}[0-9]?)"
_CLOCK = (
    r"([0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)?"
    r"|[0-9]{2}[0-9]{2}(?:[0-9]{2}(?:[.,][0-9]+)?)?)"
)
_OFFSET = (
    r"(Z| ?[+-][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)?"
    r"|[+-][0-9]{2}[0-9]{2}(?:[0-9]{2}(?:[.,][0-9]+)?)?)?"
)
ISO_SHAPE = rf"(?s)\A{_DAY}(?:.{_CLOCK}{_OFFSET})?\z"

# SQL templates over the digits of each part. Digits are padded with zeros on
# the right, so parts that were left out read as zero.
_CLOCK_MICROS = """(((int(substr({x}, 1, 2)) * 60 + int(substr({x}, 3, 2))) * 60
  + int(substr({x}, 5, 2))) * 1000000L + int(substr({x}, 7, 6)))"""
_CALENDAR_DAY = """unix_date(try_cast(
  concat_ws('-', substr({x}, 1, 4), substr({x}, 5, 2), substr({x}, 7, 2)) AS DATE))"""
_JANUARY_4 = "try_cast(concat(substr({x}, 1, 4), '-01-04') AS DATE)"
_MONDAY = f"(unix_date({_JANUARY_4}) - weekday({_JANUARY_4}) + (int(substr({{x}}, 6, 2)) - 1) * 7)"
_WEEKDAY = "coalesce(try_cast(substr({x}, 8, 1) AS INT), 1)"
# A week belongs to the year of its Thursday.
_WEEK_DAY = f"""CASE WHEN int(substr({{x}}, 6, 2)) >= 1 AND {_WEEKDAY} BETWEEN 1 AND 7
  AND year(date_from_unix_date({_MONDAY} + 3)) = int(substr({{x}}, 1, 4)) THEN {_MONDAY} + {_WEEKDAY} - 1 END"""

# Each transform over a one-element array evaluates its input once.
_TEXT_MICROS = f"""CASE
  WHEN length({{v}}) = 10 THEN
    CASE WHEN {{v}} RLIKE r'{DATE_SHAPE}' AND {{v}} >= '0001'
      THEN unix_date(try_cast({{v}} AS DATE)) * {DAY_MICROS}L END
  WHEN {{v}} RLIKE r'{USUAL_SHAPE}' AND {{v}} >= '0001' THEN
    unix_micros(try_cast(concat(translate({{v}}, ' ', 'T'),
      CASE WHEN endswith({{v}}, 'Z') OR substr({{v}}, -6, 1) IN ('+', '-') THEN '' ELSE 'Z' END) AS TIMESTAMP))
  WHEN {{v}} RLIKE r'{ISO_SHAPE}' AND {{v}} >= '0001' THEN
    transform(
      transform(
        array(split(regexp_replace({{v}}, r'{ISO_SHAPE}', '$1|$2|$3'), '[|]')),
        p -> named_struct(
          'day', translate(p[0], '-', ''),
          'clock', rpad(translate(p[1], ':.,', ''), 12, '0'),
          'shift', rpad(translate(p[2], ':., +-Z', ''), 12, '0'),
          'sign', CASE WHEN contains(p[2], '-') THEN -1 ELSE 1 END)),
      s -> CASE
        WHEN substr(s.clock, 1, 2) < '24' AND substr(s.clock, 3, 2) < '60' AND substr(s.clock, 5, 2) < '60'
          AND {_CLOCK_MICROS.format(x="s.shift")} < {DAY_MICROS}L
        THEN CASE WHEN contains(s.day, 'W') THEN {_WEEK_DAY.format(x="s.day")}
            ELSE {_CALENDAR_DAY.format(x="s.day")} END * {DAY_MICROS}L
          + {_CLOCK_MICROS.format(x="s.clock")} - s.sign * {_CLOCK_MICROS.format(x="s.shift")} END)[0]
END"""


def text_micros(name: str) -> Column:
    """Event time of a text column.

    Ten characters are a date; anything else is ISO 8601, zone-free text being
    UTC. Text that is neither gives null.
    """
    return F.expr(_TEXT_MICROS.replace("{v}", quoted(name)))


def native_micros(value: Column, data_type: T.DataType) -> Column:
    """Microseconds of a date or timestamp column."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(value)
    day = F.unix_date(value.cast("date")).cast("bigint") * DAY_MICROS
    if isinstance(data_type, T.DateType):
        return day
    seconds = F.hour(value).cast("bigint") * 3600 + F.minute(value) * 60
    fraction = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    return day + seconds * 1_000_000 + fraction


def is_native(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def latest(name: str, data_type: T.DataType) -> Column:
    """Aggregate for the latest event time; `latest_micros` turns it into microseconds."""
    if is_native(data_type):
        return F.max(column(name))
    if is_text(data_type):
        return F.max(text_micros(name))
    return F.max(F.lit(None).cast("bigint"))


def latest_micros(aggregated: Column, data_type: T.DataType) -> Column:
    return native_micros(aggregated, data_type) if is_native(data_type) else aggregated


def micros_of(moment: datetime) -> int:
    """A Python moment; one without a zone is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def moment_literal(moment: datetime) -> Column:
    """A Python moment as a zone-free UTC timestamp."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def micros_to_ntz(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def iso_utc(micros: Column) -> Column:
    """ISO text with a +00:00 offset; the fraction only when there is one."""
    text = F.date_format(micros_to_ntz(micros), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(micros, F.lit(1_000_000))
    fraction = F.when(rest == 0, "").otherwise(
        F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))
    )
    return F.concat(text, fraction, F.lit("+00:00"))


def micros_between(later: Column, earlier: Column) -> Column:
    """Whole microseconds between two zone-free timestamps."""
    ntz = T.TimestampNTZType()
    return native_micros(later, ntz) - native_micros(earlier, ntz)
