"""Relative time windows counted back from a given moment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from brooklog.functions import utc
from brooklog.functions.predicates import in_window

# Preset names and their lengths.
PRESET_LENGTHS = {
    "last-5-minutes": dt.timedelta(minutes=5),
    "last-15-minutes": dt.timedelta(minutes=15),
    "last-30-minutes": dt.timedelta(minutes=30),
    "last-60-minutes": dt.timedelta(minutes=60),
    "last-24-hours": dt.timedelta(hours=24),
    "last-7-days": dt.timedelta(days=7),
    "last-30-days": dt.timedelta(days=30),
    "last-1-year": dt.timedelta(days=365),
    "last-10-years": dt.timedelta(days=3650),
    "all-time": dt.timedelta(days=50 * 365),
}
CALENDAR_PRESETS = ("last-quarter", "year-to-date")
UNIT_LENGTHS = {
    "minutes": dt.timedelta(minutes=1),
    "hours": dt.timedelta(hours=1),
    "days": dt.timedelta(days=1),
    "weeks": dt.timedelta(weeks=1),
}


def shift_months(moment: dt.datetime, months: int) -> dt.datetime:
    """Calendar shift; a day the target month lacks runs over into the next month."""
    index = moment.year * 12 + moment.month - 1 + months
    first = moment.replace(year=index // 12, month=index % 12 + 1, day=1)
    return first + dt.timedelta(days=moment.day - 1)


def shift(moment: dt.datetime, count: int, unit: str) -> dt.datetime:
    """``count`` units forward (negative: back).  An unknown unit means one day back."""
    if unit in UNIT_LENGTHS:
        return moment + count * UNIT_LENGTHS[unit]
    if unit == "months":
        return shift_months(moment, count)
    if unit == "years":
        return shift_months(moment, 12 * count)
    return moment - dt.timedelta(days=1)


def preset_start(preset: str, now: dt.datetime) -> dt.datetime:
    """Start of a named window.  An unknown name means the last 24 hours."""
    if preset == "last-quarter":
        return shift_months(now, -3)
    if preset == "year-to-date":
        return now.replace(month=1, day=1, hour=0, minute=0, second=0, microsecond=0)
    return now - PRESET_LENGTHS.get(preset, PRESET_LENGTHS["last-24-hours"])


def window_of(now: dt.datetime, preset: str | None = None, count: int | None = None, unit: str | None = None):
    """(start, end) of a relative window; ``custom`` without a length means seven days."""
    if preset and preset != "custom":
        return preset_start(preset, now), now
    if count and unit:
        return shift(now, -count, unit), now
    return now - dt.timedelta(days=7), now


def in_last(what: str | int, unit_or_now: str | dt.datetime, now: dt.datetime | None = None, prune: bool = True) -> Column:
    """``in_last('last-7-days', now)`` or ``in_last(3, 'months', now)``."""
    if isinstance(what, int):
        start, end = window_of(now, "custom", what, unit_or_now)
    else:
        start, end = window_of(unit_or_now, what)
    return in_window(start, end, prune)


def in_zone(ts: str | Column, zone: str) -> Column:
    """Wall-clock time of a UTC timestamp in a zone, without a zone of its own."""
    return utc.wall(ts, zone)
