"""Calendar views of a timestamp in UTC, whatever the session's zone is.

Spark's own date functions cut a timestamp in the session zone.  These work on its microseconds since the epoch, so a
row has the same day, year and text in every session.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
EPOCH_DAY = dt.date(1970, 1, 1)


def div(a: Column, b: int) -> Column:
    """Whole part of a quotient, rounded down; no detour over floating point."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def _day_of(us: Column) -> Column:
    return F.date_add(F.lit(EPOCH_DAY), div(us, DAY).cast("int"))


def date(ts: str | Column) -> Column:
    """The day of a timestamp."""
    return _day_of(F.unix_micros(ts))


def time_of_day(ts: str | Column) -> Column:
    """Microseconds since midnight."""
    return F.pmod(F.unix_micros(ts), F.lit(DAY))


def year(ts: str | Column) -> Column:
    return F.year(date(ts))


def month(ts: str | Column) -> Column:
    return F.month(date(ts))


def day(ts: str | Column) -> Column:
    return F.dayofmonth(date(ts))


def midnight(day: Column) -> Column:
    """The timestamp at which a day begins."""
    return F.timestamp_micros(F.unix_date(day).cast("bigint") * DAY)


def wall(ts: str | Column, zone: str | Column = "UTC") -> Column:
    """Wall-clock time in a zone, as a timestamp without a zone."""
    at = F.from_utc_timestamp(ts if isinstance(ts, Column) else F.col(ts), zone)
    seconds = (F.unix_micros(at).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def from_wall(at: str | Column) -> Column:
    """The timestamp whose wall clock in UTC shows ``at`` (a timestamp without a zone)."""
    at = F.col(at) if isinstance(at, str) else at
    seconds = (F.unix_date(at.cast("date")).cast("bigint") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60).cast("bigint")
    return F.timestamp_micros(seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("bigint"))


def text(ts: str | Column, digits: int = 0, between: str = "T", end: str = "Z") -> Column:
    """``yyyy-MM-ddTHH:mm:ss[.digits]Z``."""
    tod = time_of_day(ts)
    second = div(tod, 1_000_000)
    parts = [div(second, 3600), F.pmod(div(second, 60), F.lit(60)), F.pmod(second, F.lit(60))]
    clock = F.concat_ws(":", *(F.lpad(p.cast("string"), 2, "0") for p in parts))
    fraction = [F.lit("."), F.substring(F.lpad(F.pmod(tod, F.lit(1_000_000)).cast("string"), 6, "0"), 1, digits)] if digits else []
    return F.concat(date(ts).cast("string"), F.lit(between), clock, *fraction, F.lit(end))
