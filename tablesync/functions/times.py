"""Time expressions on zone-less timestamps that hold UTC.

Every expression gives the same answer in any session time zone: none casts
between zone-less and zoned timestamps.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a run whose finish is the epoch is still active.
EPOCH = "1970-01-01 00:00:00"

# A date, or a date and time, with nothing behind it. Whatever else follows must be a zone.
_NO_ZONE = r"^[+-]?\d+(?:-\d{1,2}){0,2}(?:[T ](?:\d{1,2}(?::\d{1,2}(?::\d{1,2}(?:\.\d*)?)?)?)?)?$"


def ntz(value: datetime | str | Column) -> Column:
    """A zone-less literal in UTC; an aware datetime is converted first."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(UTC).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch. ``timestampdiff`` would go through the session
    zone and move times that fall in a spring gap; calendar fields do not."""
    minutes = F.unix_date(ts.cast("date")).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    seconds = F.date_part(F.lit("SECOND"), ts)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def to_epoch(ts: Column, unit: str = "ms") -> Column:
    """Unix seconds or milliseconds, truncated toward zero."""
    divisors = {"s": 1_000_000, "ms": 1_000}
    if unit not in divisors:
        raise ValueError(f"unit must be 's' or 'ms', not {unit!r}")
    return F.call_function("div", epoch_micros(ts), F.lit(divisors[unit]))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ntz(EPOCH))


def instant_to_utc(instant: Column) -> Column:
    """Zoned timestamp to its UTC reading."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), ntz(EPOCH))


def text_to_utc(text: Column) -> Column:
    """Timestamp text to UTC: an offset or zone name is applied, none means UTC. A zone
    that Spark does not know fails the cast."""
    text = F.trim(text)
    zoned = instant_to_utc(text.cast("timestamp"))
    return F.when(text.rlike(_NO_ZONE), text.cast("timestamp_ntz")).otherwise(zoned)


def try_text_to_utc(text: Column) -> Column:
    """``text_to_utc``, with NULL for text that is no time or has an unknown zone."""
    text = F.trim(text)
    zoned = instant_to_utc(text.try_cast("timestamp"))
    return F.when(text.rlike(_NO_ZONE), text.try_cast("timestamp_ntz")).otherwise(zoned)


def zoned_to_utc(local: Column, zone: Column | str) -> Column:
    """Wall-clock time in ``zone`` to UTC.

    In the hour skipped by a spring change the clock moves forward by the gap; in
    the repeated hour the earlier reading is taken.
    """
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(zone, F.lit("UTC"), local)


def day_path(ts: Column) -> Column:
    """``yyyy/MM/dd``"""
    return F.replace(F.substring(ts.cast("string"), 1, 10), F.lit("-"), F.lit("/"))


def day_minute_path(ts: Column) -> Column:
    """``yyyy/MM/dd/HHmm``"""
    text = ts.cast("string")
    return F.concat(day_path(ts), F.lit("/"), F.substring(text, 12, 2), F.substring(text, 15, 2))


def duration_seconds(started: Column, finished: Column) -> Column:
    """Fractional seconds between two times; NULL for a run that is still active."""
    seconds = (epoch_micros(finished) - epoch_micros(started)) / F.lit(1_000_000.0)
    return F.when(finished != ntz(EPOCH), seconds)


def python_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, with six decimals when there is a fraction."""
    text = ts.cast("string")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.when(F.length(text) > 19, F.concat(F.substring(text, 1, 20), fraction)).otherwise(text)
