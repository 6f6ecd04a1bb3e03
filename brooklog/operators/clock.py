"""The running clock as sums, for sources whose lines all leave out the same, and as held values.

Three kinds of source need no look at every line in turn:

* lines with the time of day alone: the day moves on by one where the time of day falls by more than twelve hours, so
  a line's day is that of the first line plus the jumps up to it;
* lines with month, day and time: the year moves on by one where the place in the year falls by more than 180 days.
  That holds as long as no line falls back by twelve hours to 180 days, which would move it on by a day, and as long
  as a leap day decides nothing; a source where this fails anywhere is of no such kind;
* without rollover, lines with a full date, with month and day, or with the time of day alone, in any mixture: a line
  takes the year of the last full date and the last named day, so both are carried along like any other value.

A jump depends on two neighbouring lines only, so jumps are marked and added up inside each block; one small row per
block (its sums, its first and last timed line) is scanned along the source and joined back.  Sources of other kinds
are followed line by line, see ``recurrence``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brooklog.functions import timeparse as tp
from brooklog.functions import utc
from brooklog.functions.utc import DAY
from brooklog.operators.ordering import KEY, before_here, earlier_blocks, join_blocks, up_to_here
from brooklog.operators.recurrence import CLAMP_SLACK, DAY_JUMP, YEAR_JUMP

DAYS, YEARS, HELD, OTHER = "days", "years", "held", "other"

# Days before each month, and of each month, in a year without a leap day.
BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
OF_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)

LINE = ("y", "mo", "d", "tod", "off", "zone")


def _timed() -> Column:
    return F.coalesce(F.col("matched"), F.lit(False)) & F.col("tod").isNotNull()


def _of_month(values: tuple[int, ...], mo: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), mo - 1)


def _is_time_only() -> Column:
    return F.col("y").isNull() & F.col("mo").isNull() & F.col("d").isNull() & (F.col("tod") >= 0)


def _is_year_day() -> Column:
    """Month and day that every year has, and a time of day within the day."""
    mo, d = F.col("mo"), F.col("d")
    regular = mo.between(1, 12) & (d >= 1) & (d <= _of_month(OF_MONTH, mo)) & (F.col("tod") >= 0) & (F.col("tod") < DAY)
    return F.col("y").isNull() & F.coalesce(regular, F.lit(False)) & ~F.col("two")


def _is_held() -> Column:
    """Without rollover: all of the date, month and day, or none of it, and a time of day within the day."""
    y, mo, d = F.col("y"), F.col("mo"), F.col("d")
    bare = y.isNull() & mo.isNull() & d.isNull()
    named = mo.between(1, 12) & d.between(1, 31) & (y.isNull() | y.between(2, 9998))
    within = (F.col("tod") >= 0) & (F.col("tod") < DAY) & (y.isNotNull() | ~F.col("two"))
    return ~F.col("rollover") & within & (bare | F.coalesce(named, F.lit(False)))


def _dates(of: Mapping[str, Column], timed: Column) -> dict[str, Column]:
    """What a timed line names: the year of its full date, and the day itself (month and day if it leaves out the year)."""
    full = timed & of["y"].isNotNull() & of["mo"].isNotNull() & of["d"].isNotNull()
    wall = tp.wall_micros(of["y"], of["mo"], of["d"], of["tod"])
    late = of["two"] & (wall - of["off"].cast("bigint") * 1_000_000 > of["anchor"] + CLAMP_SLACK)
    day = utc.div(wall, DAY)
    day = F.when(full, F.when(late, _add_year(day, -1)).otherwise(day))
    named = F.struct(day.alias("day"), of["mo"].alias("mo"), of["d"].alias("d"))
    return {"_year_of": F.year(_date(day)), "_named": F.when(timed & of["mo"].isNotNull() & of["d"].isNotNull(), named)}


def _held_day(named: Column, year: Column, opening: Column) -> Column:
    day = F.coalesce(named["day"], utc.div(tp.wall_micros(year, named["mo"], named["d"], F.lit(0)), DAY))
    return F.when(named.isNull(), opening).otherwise(day)


def _clock_of(line: Column) -> Column:
    """The time of day in UTC, as far as one day tells it."""
    return line["tod"] - line["off"].cast("bigint") * 1_000_000


def _day_jump(before: Column, now: Column, rollover: Column) -> Column:
    """Days from the day of a line to that of the next one, both with the time of day alone."""
    passed = utc.div(before["tod"], DAY)
    back = _clock_of(before) - passed * DAY - _clock_of(now)
    return (passed + F.when(rollover & (back > DAY_JUMP), 1).otherwise(0)).cast("bigint")


def _in_year(line: Column, leap: bool) -> Column:
    day = _of_month(BEFORE_MONTH, line["mo"]) + line["d"]
    day = day + F.when(line["mo"] > 2, 1).otherwise(0) if leap else day
    return day.cast("bigint") * DAY + _clock_of(line)


def _year_jump(before: Column, now: Column, rollover: Column) -> Column:
    """1 if the year moves on from one line to the next, 0 if not, null if sums cannot tell."""
    back = [_in_year(before, leap) - _in_year(now, leap) for leap in (False, True)]
    forward = (back[0] > YEAR_JUMP) & (back[1] > YEAR_JUMP)
    still = (back[0] <= DAY_JUMP) & (back[1] <= DAY_JUMP)
    return F.when(~rollover | still, 0).when(forward, 1).cast("bigint")


def _with_jumps(lines: DataFrame) -> DataFrame:
    """Mark what each timed line adds to the day and to the year of the timed line before it in its block."""
    line = F.struct(*LINE)
    marked = lines.withColumn("_line", F.when(_timed(), line))
    marked = marked.withColumn("_before", F.last("_line", ignorenulls=True).over(before_here()))
    pair = F.col("_line").isNotNull() & F.col("_before").isNotNull()
    jump = F.when(pair, _year_jump(F.col("_before"), F.col("_line"), F.col("rollover")))
    return marked.withColumns(
        {
            "_days": F.when(pair, _day_jump(F.col("_before"), F.col("_line"), F.col("rollover"))).otherwise(0),
            "_years": F.coalesce(jump, F.lit(0)),
            "_odd": pair & jump.isNull(),
        }
    )


def block_marks(lines: DataFrame) -> DataFrame:
    """One row per block: its sums, its first and last timed line, and of which kinds its lines are."""
    timed = F.col("_line").isNotNull()
    at = F.when(timed, F.col("line_no"))
    marked = _with_jumps(lines)
    dates = _dates({name: F.col(name) for name in ("y", "mo", "d", "tod", "off", "two", "anchor")}, timed)
    marked = marked.withColumns(dates)
    return marked.groupBy(*KEY).agg(
        F.min(F.when(F.col("matched"), F.col("line_no"))).alias("matched_at"),
        F.min(at).alias("timed_at"),
        F.min_by("_line", at).alias("first"),
        F.max_by("_line", at).alias("last"),
        F.sum("_days").alias("days"),
        F.sum("_years").alias("years"),
        F.max("_odd").alias("odd"),
        F.coalesce(F.min(F.when(timed, _is_time_only())), F.lit(True)).alias("time_only"),
        F.coalesce(F.min(F.when(timed, _is_year_day())), F.lit(True)).alias("year_day"),
        F.coalesce(F.min(F.when(timed, _is_held())), F.lit(True)).alias("held"),
        F.max_by("_year_of", F.when(F.col("_year_of").isNotNull(), F.col("line_no"))).alias("year_of"),
        F.max_by("_named", F.when(F.col("_named").isNotNull(), F.col("line_no"))).alias("named"),
        F.min("anchor").alias("anchor"),
        F.max("rollover").alias("rollover"),
    )


def _date(day: Column) -> Column:
    return F.date_add(F.lit(utc.EPOCH_DAY), day.cast("int"))


def _add_year(day: Column, years: int) -> Column:
    """A day some years on; a day that year lacks runs over into the next month."""
    date = _date(day)
    return utc.div(tp.wall_micros(F.year(date) + years, F.month(date), F.dayofmonth(date), F.lit(0)), DAY)


def entering(marks: DataFrame) -> DataFrame:
    """Per block: the kind of its source, the day or year of its first timed line, and the state that enters it."""
    source = Window.partitionBy("_src")
    here = source.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.withColumns(
        {
            "before": F.last("last", ignorenulls=True).over(earlier_blocks()),
            "seen": F.coalesce(F.max(F.col("matched_at").isNotNull()).over(earlier_blocks()), F.lit(False)),
        }
    )
    first, before, rollover, anchor = F.col("first"), F.col("before"), F.col("rollover"), F.col("anchor")
    opening = first.isNotNull() & before.isNull()
    follows = first.isNotNull() & before.isNotNull()
    # The first timed line of a source: behind an untimed one it follows the anchor, else its year is guessed from it.
    opened = F.col("seen") | F.coalesce(F.col("matched_at") < F.col("timed_at"), F.lit(False))
    day, year = utc.div(anchor, DAY), F.year(F.date_add(F.lit(utc.EPOCH_DAY), utc.div(anchor, DAY).cast("int")))
    plain = day * DAY + _clock_of(first)
    first_day = F.when(opened, day + F.when(rollover & (anchor - plain > DAY_JUMP), 1).otherwise(0)).otherwise(
        F.when(plain > anchor + CLAMP_SLACK, _add_year(day + utc.div(first["tod"], DAY), -1) - utc.div(first["tod"], DAY)).otherwise(day)
    )
    named = tp.wall_micros(year, first["mo"], first["d"], first["tod"]) - first["off"].cast("bigint") * 1_000_000
    back = anchor - named
    first_year = F.when(opened, year + F.when(rollover & (back > YEAR_JUMP), 1).otherwise(0)).otherwise(year - F.when(named > anchor + CLAMP_SLACK, 1).otherwise(0))
    year_link = _year_jump(before, first, rollover)
    linked = seen.withColumns(
        {
            "day_link": F.when(follows, _day_jump(before, first, rollover)).otherwise(0),
            "year_link": F.when(follows, F.coalesce(year_link, F.lit(0))).otherwise(0),
            "odd": F.col("odd") | (follows & year_link.isNull()) | F.coalesce(opening & opened & rollover & (back > DAY_JUMP) & (back <= YEAR_JUMP), F.lit(False)),
            "first_day": F.when(opening, first_day),
            "first_year": F.when(opening, first_year.cast("bigint")),
            # Held dates begin with the day or year of the first timed line; in another year a guessed 29 February is another day.
            "held_day": F.when(opening & first["mo"].isNull(), first_day),
            "held_year": F.when(opening, F.when(first["mo"].isNull(), F.year(_date(first_day))).otherwise(first_year)),
            "held": F.col("held") & ~F.coalesce(opening & ~opened & first["y"].isNull() & (first["mo"] == 2) & (first["d"] > 28), F.lit(False)),
        }
    )
    kind = (
        F.when(F.min("time_only").over(source), DAYS)
        .when(F.min("year_day").over(source) & ~F.max("odd").over(source), YEARS)
        .when(F.min("held").over(source), HELD)
        .otherwise(OTHER)
    )

    def total(name: str) -> tuple[Column, Column]:
        """The day or year of the block's first timed line, and of the last one before the block."""
        start = F.max(f"first_{name}").over(source)
        earlier = F.coalesce(F.sum(f"{name}s").over(earlier_blocks()), F.lit(0)) + start
        links = F.coalesce(F.sum(f"{name}_link").over(earlier_blocks()), F.lit(0))
        return earlier + F.sum(f"{name}_link").over(here), earlier + links

    (own_day, last_day), (own_year, last_year) = total("day"), total("year")
    by_day = F.min("time_only").over(source)
    return linked.select(
        *KEY,
        kind.alias("_kind"),
        F.when(by_day, own_day).otherwise(own_year).alias("_base"),
        F.when(by_day, last_day).otherwise(last_year).alias("_in_base"),
        F.col("before").alias("_in_line"),
        F.col("seen").alias("_in_seen"),
        F.coalesce(F.last("year_of", ignorenulls=True).over(earlier_blocks()), F.max("held_year").over(source)).alias("_in_year"),
        F.last("named", ignorenulls=True).over(earlier_blocks()).alias("_in_named"),
        F.max("held_day").over(source).alias("_in_day"),
    )


def resolve_sums(df: DataFrame, lines: dict[str, Column], states: DataFrame, kinds: set[str]) -> DataFrame:
    """``timestamp, ts_confidence, ts_zone`` of the rows of sources of the kinds ``days``, ``years`` and ``held``.

    ``lines`` are the columns of a line (``y, mo, d, tod, off, zone, two, inferred, anchor, rollover``) over ``df``;
    ``states`` is what ``entering`` gives, ``kinds`` are the kinds in it.
    """
    own = {f"_k_{name}": value for name, value in lines.items()}
    staged = df.withColumns(own)
    narrow = {name: F.col(f"_k_{name}") for name in lines}
    line = F.struct(*(narrow[c].alias(c) for c in LINE))
    timed = F.coalesce(F.col("matched"), F.lit(False)) & narrow["tod"].isNotNull()
    staged = staged.withColumn("_line", F.when(timed, line)).withColumns(
        {
            "_before": F.last("_line", ignorenulls=True).over(before_here()),
            "_held": F.last("_line", ignorenulls=True).over(up_to_here()),
            "_seen": F.max(F.col("matched")).over(before_here()),
        }
    )
    pair = F.col("_line").isNotNull() & F.col("_before").isNotNull()
    staged = staged.withColumns(
        {
            "_day": F.sum(F.when(pair, _day_jump(F.col("_before"), F.col("_line"), narrow["rollover"])).otherwise(0)).over(up_to_here()),
            "_year": F.sum(F.when(pair, _year_jump(F.col("_before"), F.col("_line"), narrow["rollover"])).otherwise(0)).over(up_to_here()),
        }
    )
    if HELD in kinds:
        staged = staged.withColumns(_dates(narrow, timed))
        staged = staged.withColumns({c: F.last(c, ignorenulls=True).over(up_to_here()) for c in ("_year_of", "_named")})
    joined = join_blocks(staged, states)
    by_day = F.col("_kind") == DAYS
    at = F.coalesce("_held", "_in_line")
    base = F.when(F.col("_held").isNotNull(), F.col("_base") + F.when(by_day, F.col("_day")).otherwise(F.col("_year"))).otherwise(F.col("_in_base"))
    joined = joined.withColumns({"_at": at, "_on": base})
    wall = F.when(by_day, F.col("_on") * DAY + F.col("_at.tod")).otherwise(tp.wall_micros(F.col("_on").cast("int"), F.col("_at.mo"), F.col("_at.d"), F.col("_at.tod")))
    if HELD in kinds:
        day = _held_day(F.coalesce("_named", "_in_named"), F.coalesce("_year_of", "_in_year"), F.col("_in_day"))
        wall = F.when(F.col("_kind") == HELD, day * DAY + F.col("_at.tod")).otherwise(wall)
    seen = F.coalesce(F.col("_seen"), F.lit(False)) | F.col("_in_seen")
    label = (
        F.when(F.col("_line").isNotNull(), F.when(narrow["inferred"], "inferred").otherwise("exact"))
        .when(F.col("_at").isNotNull() | seen, "carried")
        .otherwise("synthetic")
    )
    out = joined.withColumns(
        {
            "timestamp": F.coalesce(tp.to_utc(wall, F.col("_at.zone")), F.timestamp_micros(narrow["anchor"])),
            "ts_confidence": label,
            "ts_zone": F.coalesce(F.col("_at.zone"), F.lit("+00:00")),
        }
    )
    return out.drop(*own, "_line", "_before", "_held", "_seen", "_day", "_year", "_kind", "_base", "_in_base", "_in_line", "_in_seen", "_in_year", "_in_named", "_in_day", "_year_of", "_named", "_at", "_on")
