"""ISO timestamps as text, and calendar days nine hours ahead of UTC."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

OFFSET = "+09:00"  # of the calendar days


def instant(text: Column) -> Column:
    """The instant of an ISO-8601 text (without a zone: UTC, whatever the session's zone); null if it is none."""
    zoned = text.rlike(r"(Z|[+-]\d\d(:?\d\d)?)\s*$") & text.contains(":")
    return F.try_to_timestamp(F.when(zoned, text).when(text.contains(":"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z"))))


def day_start(day: str) -> Column:
    """The instant at which a calendar day (yyyy-mm-dd) starts at OFFSET; other texts are instants."""
    return F.try_to_timestamp(F.lit(f"{day}T00:00:00{OFFSET}")) if len(day) == 10 else instant(F.lit(day))


def day_end(day: str) -> Column:
    """The exclusive upper bound for `day`: the start of the next calendar day, or the instant itself."""
    return day_start((date.fromisoformat(day) + timedelta(days=1)).isoformat()) if len(day) == 10 else instant(F.lit(day))


def within(text: Column, since: str | None, until: str | None) -> Column:
    """Whether a timestamp text lies in [since, until); texts that are no timestamps pass."""
    at, keep = instant(text), F.lit(True)
    if since:
        keep = keep & (at >= day_start(since))
    if until:
        keep = keep & (at < day_end(until))
    return at.isNull() | keep


def iso(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
