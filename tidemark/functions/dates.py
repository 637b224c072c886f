"""Calendar functions; the time zone of every one is explicit."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The batch deadline and its zone.
WINDOW_ZONE = "Asia/Singapore"
WINDOW_END = "06:00"

_DAY_MS = 86_400_000


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp read as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def utc_date(ts_ms: Column) -> Column:
    """UTC calendar date of epoch milliseconds."""
    days = (ts_ms - F.pmod(ts_ms, F.lit(_DAY_MS))) / _DAY_MS
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def dt_utc(ts_ms: Column) -> Column:
    """`yyyyMMdd` of epoch milliseconds in UTC."""
    return F.date_format(utc_date(ts_ms), "yyyyMMdd")


def sgt_time(ts_ms: Column) -> Column:
    """Wall clock in Singapore of epoch milliseconds (session zone UTC)."""
    return F.from_utc_timestamp(F.timestamp_millis(ts_ms), WINDOW_ZONE)


def business_date(now_ms: Column) -> Column:
    """The default business date: yesterday in Singapore."""
    return F.date_sub(F.to_date(sgt_time(now_ms)), 1)


def date_key(date: Column) -> Column:
    """Integer `yyyyMMdd` of a date."""
    return F.date_format(date, "yyyyMMdd").cast("int")


def iso_day_of_week(date: Column) -> Column:
    """ISO weekday, 1 is Monday."""
    return F.weekday(date) + 1


def within_window(completed_ms: Column) -> Column:
    """Completion at or before 06:00:00.000 Singapore time; looks at the time of day only."""
    return F.date_format(sgt_time(completed_ms), "HH:mm:ss.SSS") <= f"{WINDOW_END}:00.000"


def within_window_strict(completed_ms: Column, date: Column) -> Column:
    """As `within_window`, and completed on the Singapore day after the business date or earlier."""
    day = F.to_date(sgt_time(completed_ms))
    return (day <= date) | ((day == F.date_add(date, 1)) & within_window(completed_ms))


def window_line(date: Column, completed_ms: Column) -> Column:
    """The one-line contract of the batch-window verdict."""
    return F.concat(
        F.lit("BATCH-WINDOW businessDate="), F.date_format(date, "yyyy-MM-dd"),
        F.lit(" completedAtSGT="), F.date_format(sgt_time(completed_ms), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit(f" {WINDOW_ZONE} windowEndSGT={WINDOW_END} withinWindow="),
        within_window(completed_ms).cast("string"),
    )


def freshness_seconds(source_ts_ms: Column, now_ms: Column) -> Column:
    """Whole seconds between source commit and now, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor((now_ms - source_ts_ms) / 1000).cast("bigint"))


def parse_business_date(text: str) -> dt.date:
    """Strict `YYYY-MM-DD` driver argument."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"business date must be YYYY-MM-DD, got {text!r}")
    return dt.date.fromisoformat(text)


def default_business_date(now: dt.datetime | None = None) -> dt.date:
    """Yesterday in Singapore for the driver."""
    now = now or dt.datetime.now(dt.timezone.utc)
    return (now.astimezone(dt.timezone(dt.timedelta(hours=8))) - dt.timedelta(days=1)).date()
