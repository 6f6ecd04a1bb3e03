"""Reading times out of text.

Every reader gives a struct ``(y, mo, d, tod, zone)``: year (null when the text has none),
month, day, microseconds of the day, and a zone (``+HH:MM`` or a zone name; null when the
text has none).  A text that is no time gives null.
"""

from __future__ import annotations

import re
import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.functions import utc

PARTS = "struct<y:int,mo:int,d:int,tod:bigint,zone:string>"
CUT = "\uffff"

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)"
_MON = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_NAMED_DAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? )?"

# Shapes tried in order: (regex, which group holds year, month, day, hour, minute, second, fraction, zone).
# Group 0 stands for "not in this shape".
SHAPES = (
    (rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]{_CLOCK} ?{_ZONE}?)?", (1, 2, 3, 4, 5, 6, 7, 8)),
    (r"(\d{4})-(\d{2})-(\d{2})-(\d{2})\.(\d{2})\.(\d{2})(?:\.(\d{1,9}))?", (1, 2, 3, 4, 5, 6, 7, 0)),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_CLOCK})?", (3, 1, 2, 4, 5, 6, 7, 0)),
    (rf"(\d{{1,2}})/{_MON}/(\d{{4}}):(\d{{2}}):(\d{{2}}):(\d{{2}})(?: {_ZONE})?", (3, 2, 1, 4, 5, 6, 0, 7)),
    (rf"{_NAMED_DAY}{_MON} (\d{{1,2}}) {_CLOCK}(?: {_ZONE})?(?: (\d{{4}}))?", (8, 1, 2, 3, 4, 5, 6, 7)),
    (rf"{_NAMED_DAY}{_MON} (\d{{1,2}}),? (\d{{4}})(?:,? {_CLOCK}(?: {_ZONE})?)?", (3, 1, 2, 4, 5, 6, 7, 8)),
    (rf"{_NAMED_DAY}(\d{{1,2}})[ -]{_MON}[ -](\d{{4}})(?: {_CLOCK}(?: {_ZONE})?)?", (3, 2, 1, 4, 5, 6, 7, 8)),
    (r"(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?", (1, 2, 3, 4, 5, 6, 0, 0)),
)

MONTH_NAMES = "JanFebMarAprMayJunJulAugSepOctNovDec"

# Reference-date layout elements and what Spark calls them, longest first.
LAYOUT_ELEMENTS = (
    ("2006", "yyyy"),
    ("January", "MMMM"),
    ("Monday", "EEEE"),
    ("Z07:00", "XXX"),
    ("-07:00", "xxx"),
    ("-0700", "xx"),
    ("Jan", "MMM"),
    ("Mon", "EEE"),
    ("MST", "z"),
    ("01", "MM"),
    ("02", "dd"),
    ("_2", "d"),
    ("03", "hh"),
    ("04", "mm"),
    ("05", "ss"),
    ("06", "yy"),
    ("15", "HH"),
    ("PM", "a"),
    ("1", "M"),
    ("2", "d"),
    ("3", "h"),
)

UNIX_HINTS = {"unix_seconds": 0, "unix_millis": 3, "unix_micros": 6, "unix_nanos": 9}
EPOCH_DIGITS = {10: 0, 13: 3, 16: 6, 19: 9}


@lru_cache(maxsize=1)
def _zone_names() -> str:
    """All zone names as one comma-separated literal (a list would be hundreds of literals in the plan)."""
    odd = {"localtime", "Factory", "posixrules"}
    return ",".join(sorted(n for n in zoneinfo.available_timezones() if n not in odd))


def _offset(zone: Column) -> Column:
    """``±HH:MM`` of a zone a shape let through; a named or missing one is UTC."""
    digits = F.rpad(F.regexp_replace(F.substring(zone, 2, 5), ":", ""), 4, "0")
    offset = F.concat(F.substring(zone, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))
    return F.when(F.substring(zone, 1, 1).isin("+", "-"), offset).otherwise("+00:00")


def parse_tz(text: Column) -> Column:
    """Zone of a text: blank or ``Z`` is UTC; zone names, ``±HH[:]MM`` and ``±HH`` are kept; else null."""
    t = F.trim(text)
    sign = F.when(t.startswith("-"), "-").otherwise("+")
    digits = F.regexp_replace(t, r"[+\-:]", "")
    offset = F.concat(sign, F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0"))
    return (
        F.when(t.isin("", "Z", "z", "UTC", "GMT"), "+00:00")
        .when(t.rlike(r"^[+-]?(?:0\d|1[0-7])(?::?[0-5]\d)?$"), offset)
        .when(F.find_in_set(t, F.lit(_zone_names())) > 0, t)
    )


def _month(text: Column) -> Column:
    at = F.instr(F.lit(MONTH_NAMES), text)
    named = F.when((F.length(text) == 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))
    return F.coalesce(text.try_cast("int"), named)


def _fraction(text: Column) -> Column:
    return F.coalesce(F.rpad(F.substring(text, 1, 6), 6, "0").try_cast("bigint"), F.lit(0))


def _tod(h: Column, mi: Column, s: Column, us: Column) -> Column:
    total = (h.cast("bigint") * 3600 + mi * 60 + F.coalesce(s, F.lit(0))) * 1_000_000 + us
    return F.when((h <= 23) & (mi <= 59) & (F.coalesce(s, F.lit(0)) <= 59), total)


def _of_moment(ts: Column) -> Column:
    """Parts of a real timestamp in UTC."""
    return F.struct(
        utc.year(ts).alias("y"),
        utc.month(ts).alias("mo"),
        utc.day(ts).alias("d"),
        utc.time_of_day(ts).alias("tod"),
        F.lit("+00:00").alias("zone"),
    ).cast(PARTS)


def _epoch(text: Column, power: Column | int) -> Column:
    """Digits counting seconds (0), milliseconds (3), microseconds (6) or nanoseconds (9)."""
    value, unit = text.try_cast("bigint"), power if isinstance(power, Column) else F.lit(power)
    us = (
        F.when(unit == 0, value * 1_000_000)
        .when(unit == 3, value * 1000)
        .when(unit == 6, value)
        .when(unit == 9, F.call_function("div", value, F.lit(1000)))
    )
    return F.when(us.isNotNull(), _of_moment(F.timestamp_micros(us)))


def layout_to_pattern(layout: str) -> str:
    """A reference-date layout (``2006-01-02 15:04:05``) as a Spark datetime pattern."""
    out, i = [], 0
    while i < len(layout):
        fraction = re.match(r"[.,](0+|9+)(?!\d)", layout[i:])
        if fraction and i > 0:
            out.append(layout[i] + "S" * min(len(fraction.group(1)), 9))
            i += fraction.end()
            continue
        for element, pattern in LAYOUT_ELEMENTS:
            if layout.startswith(element, i):
                out.append(pattern)
                i += len(element)
                break
        else:
            c = layout[i]
            out.append(f"'{c}'" if c.isalpha() else c)
            i += 1
    return "".join(out)


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def _one_pattern() -> tuple[str, str]:
    """All shapes as one alternation, and the replacement that puts each slot's groups together.

    Only one alternative takes part in a match, so the groups of the others are empty.
    """
    offset, alternatives, slots = 0, [], [""] * 8
    for pattern, groups in SHAPES:
        alternatives.append(pattern)
        for i, g in enumerate(groups):
            slots[i] += f"${g + offset}" if g else ""
        offset += re.compile(pattern).groups
    return rf"\A(?:{'|'.join(alternatives)})\z", "".join(CUT + s for s in slots)


SHAPE, SHAPE_SLOTS = _one_pattern()


def _rewritten(t: Column) -> Column:
    """The slots of a known shape, joined by CUT; other texts stay as they are."""
    return F.regexp_replace(t, SHAPE, SHAPE_SLOTS)


def _shaped(p: Column) -> Column:
    """Parts from the split slots (null when the text had no known shape)."""

    def part(i: int) -> Column:
        return F.get(p, i)

    tod = _tod(
        F.coalesce(part(4).try_cast("int"), F.lit(0)),
        F.coalesce(part(5).try_cast("int"), F.lit(0)),
        part(6).try_cast("int"),
        _fraction(part(7)),
    )
    month, day = _month(part(2)), part(3).try_cast("int")
    good = (F.size(p) > 8) & month.between(1, 12) & day.between(1, 31) & tod.isNotNull()
    return F.when(
        good,
        F.struct(
            part(1).try_cast("int").alias("y"),
            month.alias("mo"),
            day.alias("d"),
            tod.alias("tod"),
            _offset(part(8)).alias("zone"),
        ).cast(PARTS),
    )


def _epoch_by_length(t: Column) -> Column:
    digits, unit = F.when(t.rlike(r"^\d+$"), F.length(t)), None
    for n, power in EPOCH_DIGITS.items():
        unit = F.when(digits == n, power) if unit is None else unit.when(digits == n, power)
    return _epoch(t, unit)


def _by_hint(text: Column, hint: str) -> Column:
    t = F.trim(text)
    if hint == "unix_nanos":
        return _epoch(t, F.when(F.length(t) == 16, 6).otherwise(9))
    if hint in UNIX_HINTS:
        return _epoch(t, UNIX_HINTS[hint])
    pattern = layout_to_pattern(hint)
    if not re.search("[xXzVO]", re.sub("'[^']*'", "", pattern)):
        # Said in full, so that the session's zone does not come in.
        t, pattern = F.concat(t, F.lit(" +00:00")), f"{pattern} xxx"
    moment = F.try_to_timestamp(t, F.lit(pattern))
    return F.when(moment.isNotNull(), _of_moment(moment))


def parse_ts(text: Column, hint: str = "") -> Column:
    """One value as a time: known shapes, then epochs by digit count; a hint forces one way.

    Hints: ``unix_seconds``, ``unix_millis``, ``unix_micros``, ``unix_nanos``, or a
    reference-date layout.  A text without a zone counts as UTC.
    """
    if hint:
        return _by_hint(text, hint)
    t = _clean(text)
    return F.coalesce(_shaped(F.split(_rewritten(t), CUT, -1)), _epoch_by_length(t))


def with_parsed_ts(df: DataFrame, out: str, text: Column, hint: str = "") -> DataFrame:
    """``parse_ts`` in steps, so the regular expressions run once per row."""
    if hint:
        return df.withColumn(out, _by_hint(text, hint))
    staged = df.withColumn("_clean", _clean(text)).withColumn("_slots", F.split(_rewritten(F.col("_clean")), CUT, -1))
    return staged.withColumn(out, F.coalesce(_shaped(F.col("_slots")), _epoch_by_length(F.col("_clean")))).drop(
        "_clean", "_slots"
    )


def format_of(text: Column) -> Column:
    """How ``parse_ts`` reads a value: ``auto``, one of the epoch hints, or null."""
    t = F.trim(text)
    digits = F.when(t.rlike(r"^\d+$"), F.length(t))
    return (
        F.when(parse_ts(text).isNull(), None)
        .when(digits == 10, "unix_seconds")
        .when(digits == 13, "unix_millis")
        .when(digits.isin(16, 19), "unix_nanos")
        .otherwise("auto")
    )


DATE = "struct<y:int,mo:int,d:int>"


def plain_date(text: Column) -> Column:
    """``yyyymmdd``, or three numbers with the year first, as ``(y, mo, d)``."""
    t = F.trim(text)
    y, m, d = (F.substring(t, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    packed = t.rlike(r"^\d{8}$") & (y > 1900) & m.between(1, 12) & d.between(1, 31)
    cut = F.split(t, r"[-/.]")
    threefold = t.rlike(r"^\d+(?:-\d+-|/\d+/|\.\d+\.)\d+$")
    thirds = [F.get(cut, i).try_cast("int").alias(n) for i, n in enumerate(("y", "mo", "d"))]
    return F.when(packed, F.struct(y.alias("y"), m.alias("mo"), d.alias("d")).cast(DATE)).when(
        threefold, F.struct(*thirds).cast(DATE)
    )


def parse_date(text: Column) -> Column:
    """A date field as ``(y, mo, d)``; anything ``parse_ts`` reads is a date too."""
    other = parse_ts(text)
    return F.coalesce(
        plain_date(text),
        F.when(other.isNotNull(), F.struct(other["y"].alias("y"), other["mo"].alias("mo"), other["d"].alias("d"))),
    )


CLOCK = r"\A(\d+):(\d+)(?::(\d+))?(?::\d+)*(?:[.,](\d*))?(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2})?\z"


def parse_time(text: Column) -> Column:
    """A time field as ``(tod, zone)``: ``HH:MM[:SS[.,fraction]]`` with an optional zone suffix."""
    slots = F.regexp_replace(F.trim(text), CLOCK, "".join(f"{CUT}${i}" for i in range(1, 6)))
    bound = F.transform(F.array(F.split(slots, CUT, -1)), _clock_of)  # bound once, used many times
    return F.get(bound, 0)


def _clock_of(p: Column) -> Column:
    h, mi, s = (F.get(p, i).try_cast("bigint") for i in (1, 2, 3))
    tod = (h * 3600 + mi * 60 + F.coalesce(s, F.lit(0))) * 1_000_000 + _fraction(F.get(p, 4))
    zone = F.when(F.get(p, 5) != "", parse_tz(F.get(p, 5)))
    return F.when(
        F.size(p) > 5, F.struct(tod.alias("tod"), zone.alias("zone")).cast("struct<tod:bigint,zone:string>")
    )


def offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a fixed offset; a zone name counts as 0 here."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    return F.when(
        zone.rlike(r"^[+-]\d\d:\d\d$"),
        sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60),
    ).otherwise(0)


def wall_micros(y: Column, mo: Column, d: Column, tod: Column) -> Column:
    """Wall-clock microseconds; a day the month lacks runs over into the next month."""
    first = F.try_make_timestamp(y, mo, F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return F.unix_micros(first) + (d.cast("bigint") - 1) * 86_400_000_000 + tod


def to_utc(wall_us: Column, zone: Column) -> Column:
    """UTC timestamp of a wall-clock time in a zone."""
    return F.to_utc_timestamp(F.timestamp_micros(wall_us), F.coalesce(zone, F.lit("UTC")))
