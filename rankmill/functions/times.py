"""Times. Stored times are wall-clock times of the local zone without a zone (timestamp_ntz)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill import fixed_values as fv

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def moment(value: datetime | str | Column) -> Column:
    """A wall-clock time as a foldable literal, so that filters on it reach the file scan."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def seconds(n: int | float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def age_seconds(as_of: Column, then: Column) -> Column:
    """Whole seconds from `then` to `as_of`."""
    return F.timestamp_diff("SECOND", then, as_of)


def relative_age(then: Column, as_of: datetime | Column) -> Column:
    """`5초 전`, `12분 전`, `3시간 전`; a label of its own when there is no time."""
    age = age_seconds(moment(as_of), then)
    minutes = F.call_function("div", age, F.lit(60))
    hours = F.call_function("div", age, F.lit(3600))
    return (
        F.when(then.isNull(), fv.NO_TIME_LABEL)
        .when(age < 60, F.concat(age.cast("string"), F.lit(fv.SECONDS_AGO)))
        .when(age < 3600, F.concat(minutes.cast("string"), F.lit(fv.MINUTES_AGO)))
        .otherwise(F.concat(hours.cast("string"), F.lit(fv.HOURS_AGO)))
    )


# Accepted date texts.
DATE_FORMATS = ("yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm:ss")


def parse_datetime_or(text: Column, fallback: datetime | Column, formats=DATE_FORMATS) -> Column:
    parsed = [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    return F.coalesce(*parsed, moment(fallback))


def to_local_zone(utc_wall_clock: Column, zone: str = fv.LOCAL_ZONE) -> Column:
    """Wall clock of UTC -> wall clock of the local zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall_clock)


def parse_to_local(text: Column, strict: bool = False, zone: str = fv.LOCAL_ZONE) -> Column:
    """ISO text -> local wall clock.

    Text with an offset is converted; text without one is taken as local, or
    refused (null) when `strict`.
    """
    offset = F.regexp_extract(text, r"([+-][0-9]{2}:[0-9]{2}|Z)$", 1)
    bare = F.regexp_replace(text, r"([+-][0-9]{2}:[0-9]{2}|Z)$", "").try_cast("timestamp_ntz")
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    hours = F.coalesce(F.substring(offset, 2, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.substring(offset, 5, 2).try_cast("int"), F.lit(0))
    shift = F.make_dt_interval(F.lit(0), hours * sign, minutes * sign)
    naive = F.lit(None).cast("timestamp_ntz") if strict else bare
    return F.when(offset == "", naive).otherwise(to_local_zone(bare - shift, zone))


def day_start(then: datetime | Column) -> Column:
    return F.date_trunc("day", moment(then)).cast("timestamp_ntz")


def hms(total_seconds: Column) -> Column:
    """Elapsed seconds -> `HH:MM:SS`."""
    whole = total_seconds.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d",
        F.call_function("div", whole, F.lit(3600)),
        F.call_function("div", whole % 3600, F.lit(60)),
        whole % 60,
    )


def format_ts(then: Column, zone_label: str = fv.ZONE_LABEL) -> Column:
    return F.concat(F.date_format(then, "yyyy-MM-dd HH:mm:ss"), F.lit(zone_label))


def iso_local(then: Column) -> Column:
    """`2025-05-15T09:40:00+09:00`"""
    return F.concat(F.date_format(then, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(fv.LOCAL_OFFSET))


def compact_date(then: Column) -> Column:
    return F.date_format(then, "yyyyMMdd")


def midnight_minutes(then: Column) -> Column:
    """Whole minutes to the next local midnight."""
    midnight = day_start(then) + days(1)
    return F.call_function("div", age_seconds(midnight, then), F.lit(60))


def weekly_slot(then: Column, last_done: Column | None = None) -> Column:
    """True in the minute Wednesday 18:30 when nothing was done on that day yet."""
    due = (F.dayofweek(then) == 4) & (F.hour(then) == 18) & (F.minute(then) == 30)
    if last_done is None:
        return due
    return due & F.coalesce(F.to_date(last_done) != F.to_date(then), F.lit(True))


def time_slot(wall_clock: Column, width: int) -> Column:
    """Number of the `width` seconds long slot a time falls into; plain interval arithmetic, no zone."""
    return F.call_function("div", wall_clock - F.expr(EPOCH), F.expr(f"INTERVAL '{int(width)}' SECOND"))


def instant_of(wall_clock: Column, zone: str = fv.LOCAL_ZONE) -> Column:
    """Local wall clock -> instant (timestamp), whatever the session time zone is."""
    in_utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall_clock)
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), in_utc)
    return F.timestamp_micros(micros)


def wall_clock_of(instant: Column, zone: str = fv.LOCAL_ZONE) -> Column:
    """Instant (timestamp) -> local wall clock, whatever the session time zone is."""
    in_utc = F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(EPOCH))
    return to_local_zone(in_utc, zone)
