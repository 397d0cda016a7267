"""Date helpers: week start, trailing-window cutoff, calendar buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def as_datetime(as_of: dt.date | dt.datetime | str) -> dt.datetime:
    """Accepts a datetime, a date (midnight) or an ISO string."""
    if isinstance(as_of, str):
        return dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.datetime):
        return as_of
    return dt.datetime(as_of.year, as_of.month, as_of.day)


def wall_clock(value: dt.datetime | dt.date | str) -> Column:
    """A TIMESTAMP_NTZ literal (wall-clock time): independent of the session
    and process time zones."""
    return F.to_timestamp_ntz(F.lit(as_datetime(value).isoformat(sep=" ")))


def cutoff(as_of, days_back: int) -> Column:
    """``as_of - days_back days`` as a wall-clock timestamp literal.  It keeps
    the time of day, so at noon the session dated exactly ``days_back`` days
    ago is out."""
    return wall_clock(as_datetime(as_of) - dt.timedelta(days=days_back))


def on_or_after(date_col: Column | str, as_of, days_back: int) -> Column:
    """``date >= as_of - days_back`` compared as timestamps (date at midnight);
    a NULL date fails, future dates pass (no upper bound)."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return c.cast("timestamp_ntz") >= cutoff(as_of, days_back)


def week_start(date_col: Column | str) -> Column:
    """Monday of the week, as a DATE."""
    return F.trunc(F.col(date_col) if isinstance(date_col, str) else date_col, "week")


def utc_midnight(date_col: Column | str) -> Column:
    """Event time for a DATE: its midnight as an instant in UTC, whatever the
    session time zone (streaming windows need TIMESTAMP, not TIMESTAMP_NTZ)."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.timestamp_seconds(F.unix_date(c).cast("long") * 86400)


def utc_date(ts_col: Column | str) -> Column:
    """The UTC calendar date of an instant, whatever the session time zone."""
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))


def month_index(date_col: Column | str) -> Column:
    """Months since year 0, so RANGE frames can step exactly one or twelve months."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.year(c) * 12 + F.month(c) - 1
