"""Dates, ages, rounding, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shanghai_day(at: Column) -> Column:
    """Calendar day at +08:00; the session's time zone is UTC."""
    return F.to_date(F.from_utc_timestamp(at, "Asia/Shanghai"))


def age_days(at: Column, as_of: Column) -> Column:
    """Whole days from at to as_of, 0 at least; null if either is."""
    return F.when(at.isNotNull() & as_of.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)).cast("int"))


def rounded(x: Column) -> Column:
    """Half upwards, also below zero."""
    return F.floor(x + 0.5)


def parsed_epoch(text: Column) -> Column:
    """Digits as epoch: below 1e11 seconds, else milliseconds."""
    n = text.cast("double")
    return F.when(text.rlike(r"^[0-9]{10,13}$"), F.timestamp_millis(F.when(n < 1e11, n * 1000).otherwise(n).cast("long")))


def parsed_date(text: Column) -> Column:
    """Epoch digits, ISO 8601, or a mail date with or without its weekday; null otherwise."""
    bare = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(parsed_epoch(text), F.try_to_timestamp(text), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")))


def cooldown_seconds(failures: Column, gone: Column) -> Column:
    """Seconds until a failing source's next try: none below 3 failures, 7 days if it is gone, else 2 h doubled each time."""
    doubled = 7200 * F.pow(F.lit(2), F.least(failures - 3, F.lit(12)))
    return F.when(failures < 3, None).when(gone, 604800).otherwise(F.least(F.lit(604800), doubled).cast("int"))
