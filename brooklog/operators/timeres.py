"""Event times of whole sources: parts, completion, carry-forward, rollover, quality."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brooklog.functions import timeparse as tp
from brooklog.functions import utc
from brooklog.functions.grok import Pattern
from brooklog.model import micros
from brooklog.operators import clock
from brooklog.operators.ordering import KEY, NO_BLOCK, NO_SOURCE, carry, join_blocks, restore_keys, settle_keys, with_seq
from brooklog.operators.recurrence import block_summary, block_times, entering_blocks, entering_times, run_summary
from brooklog.session import BROADCAST_ROWS, settle, settle_rows

#: Blocks whose effects one task composes.
RUN_BLOCKS = 4096

TIME_FIELDS = (
    "timestamp", "date", "time", "year", "month", "day", "hour", "minute", "second", "millis", "nanos", "tz",
)


@dataclass(frozen=True)
class TimeConfig:
    """How the lines of a frame get their time.

    ``anchor`` fills what the lines leave out and bounds guessed years from above;
    ``anchor_column`` takes it from a column (a file's modification time).  ``dated`` says
    that every timed line carries a full date, so lines need no look at their neighbours
    beyond carry-forward; with ``rollover`` or without ``dated`` the source's clock is
    followed line by line.  ``zone`` overrides every line's zone.
    """

    anchor: dt.datetime | None = None
    anchor_column: str | None = None
    year_strategy: str = "from_anchor"
    forced_year: int | None = None
    forced_month: int | None = None
    forced_day: int | None = None
    force_mode: str = "fill_missing"
    zone: str | None = None
    rollover: bool = True
    dated: bool = False
    synthetic: bool = False
    source_field: str = ""
    source_format: str = ""

    def __post_init__(self) -> None:
        if self.force_mode not in ("fill_missing", "overwrite"):
            raise ValueError(f"unknown force mode {self.force_mode!r}")
        if self.anchor is None and not self.anchor_column:
            raise ValueError("an anchor is needed")


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col("attrs")[name]), F.lit(""))


def _int(name: str) -> Column:
    return F.col("attrs")[name].try_cast("int")


def with_hinted(df: DataFrame, hints: Sequence[Pattern]) -> DataFrame:
    """Add ``_said``: the time that the pattern a row was matched by says where to find, and how to read.

    Without patterns that say so the column is left out.
    """
    by_way: dict[str, dict[str, list[str]]] = {}
    for p in hints:
        if p.timestamp_field:
            by_way.setdefault(p.timestamp_layout, {}).setdefault(p.timestamp_field, []).append(p.name)
    if "pattern" not in df.columns or not by_way:
        return df
    ways = []
    for i, (layout, fields) in enumerate(by_way.items()):
        text = F.coalesce(*(F.when(F.col("pattern").isin(names), _text(field)) for field, names in fields.items()))
        df = tp.with_parsed_ts(df, f"_way{i}", text, layout)
        ways.append(f"_way{i}")
    return df.withColumn("_said", F.coalesce(*ways)).drop(*ways)


def extract_parts(df: DataFrame, source_field: str | Column = "", source_format: str = "", hints: Sequence[Pattern] = ()) -> DataFrame:
    """Add ``_parts`` (y, mo, d, tod, zone) from ``attrs``; ``tod`` is null on a line without a time.

    The field that a pattern's time hint names comes first, then a chosen source field, then a full ``timestamp``, then the single
    components: year/month/day with ``date`` filling gaps, ``time`` or hour+minute+second,
    ``millis``/``nanos`` and ``tz``.
    """
    # One pass of the time shapes serves a full timestamp or, without one, an unusual date.
    stamp, date = _text("timestamp"), _text("date")
    out = with_hinted(df, hints).withColumn("_date", tp.plain_date(date))
    odd = F.when(F.col("_date").isNull(), date)
    shown = F.coalesce(stamp, odd)
    # What a hint has read is not read again.
    out = tp.with_parsed_ts(out, "_stamp", F.when(F.col("_said").isNull(), shown) if "_said" in out.columns else shown)
    if isinstance(source_field, Column) or source_field:
        chosen = F.nullif(F.trim(F.col("attrs")[source_field]), F.lit(""))
        out = tp.with_parsed_ts(out, "_chosen", chosen, source_format)
    out = out.withColumn("_time", tp.parse_time(_text("time")))

    def named(part: str, name: str) -> Column:
        odd_part = F.when(stamp.isNull(), F.col(f"_stamp.{part}"))
        return F.coalesce(*[F.nullif(c, F.lit(0)) for c in (_int(name), F.col(f"_date.{part}"), odd_part)])

    h, mi, s = _int("hour"), _int("minute"), _int("second")
    micros_part = F.coalesce((_int("nanos") / 1000).cast("bigint"), _int("millis").cast("bigint") * 1000, F.lit(0))
    clock = (h.cast("bigint") * 3600 + mi * 60 + s) * 1_000_000 + micros_part
    tod = F.when(_text("time").isNotNull(), F.col("_time.tod")).otherwise(clock)
    zone = F.coalesce(tp.parse_tz(_text("tz")), F.col("_time.zone"))
    composed = F.struct(
        named("y", "year").alias("y"),
        named("mo", "month").alias("mo"),
        named("d", "day").alias("d"),
        tod.alias("tod"),
        zone.alias("zone"),
    ).cast(tp.PARTS)
    whole = [F.col("_said")] if "_said" in out.columns else []
    whole += [F.col("_chosen")] if "_chosen" in out.columns else []
    whole.append(F.when(stamp.isNotNull(), F.col("_stamp")))
    return out.withColumn("_parts", F.coalesce(*whole, composed)).drop("_said", "_chosen", "_stamp", "_date", "_time")


def _force(given: Column, filled: Column, forced: int | None, mode: str) -> Column:
    if forced is None:
        return filled
    if mode == "overwrite":
        return F.lit(forced)
    return F.when(given.isNull(), F.lit(forced)).otherwise(filled)


def _line_columns(df: DataFrame, cfg: TimeConfig) -> DataFrame:
    """Final year, month, day, time of day and zone of a line, as far as the line itself gives them."""
    p = F.col("_parts")
    given_y = F.nullif(p["y"], F.lit(0))
    two = F.coalesce((given_y > 0) & (given_y < 100), F.lit(False))
    anchor_year = utc.year("_anchor")
    century = F.floor(anchor_year / 100) * 100 + given_y
    expanded = F.when(century > anchor_year, century - 100).otherwise(century).cast("int")
    pinned = cfg.year_strategy == "forced" and cfg.forced_year is not None
    if pinned:
        expanded = F.lit(cfg.forced_year)
    y = F.when(two, expanded).otherwise(F.coalesce(given_y, F.lit(cfg.forced_year if pinned else None).cast("int")))
    inferred = p["y"].isNull() | two | p["mo"].isNull() | p["d"].isNull()
    zone = F.lit(cfg.zone) if cfg.zone else F.coalesce(p["zone"], F.lit("+00:00"))
    if cfg.zone:
        zone = tp.parse_tz(zone)
    return df.withColumns(
        {
            "_y": _force(p["y"], y, cfg.forced_year, cfg.force_mode),
            "_mo": _force(p["mo"], p["mo"], cfg.forced_month, cfg.force_mode),
            "_d": _force(p["d"], p["d"], cfg.forced_day, cfg.force_mode),
            "_tod": p["tod"],
            "_zone": F.coalesce(zone, F.lit("+00:00")),
            "_two": two,
            "_inferred": inferred,
        }
    ).drop("_parts")


def _clamped(wall: Column, guessed: Column) -> Column:
    """A guessed year must not lead past the anchor: go back one year."""
    at = F.unix_micros(tp.to_utc(wall, F.col("_zone")))
    moment = F.timestamp_micros(wall)
    back = tp.wall_micros(
        utc.year(moment) - 1, utc.month(moment), utc.day(moment), F.pmod(wall, F.lit(utc.DAY))
    )
    late = guessed & (at > F.unix_micros("_anchor") + F.lit(3_600_000_000))
    return F.when(late, back).otherwise(wall)


def _resolve_dated(df: DataFrame) -> DataFrame:
    """Every timed line stands on its own; lines without a time take the last one before them."""
    full = F.col("_tod").isNotNull() & F.col("matched")
    wall = tp.wall_micros(
        F.coalesce("_y", utc.year("_anchor")),
        F.coalesce("_mo", utc.month("_anchor")),
        F.coalesce("_d", utc.day("_anchor")),
        F.col("_tod"),
    )
    timed = df.withColumn("_wall", F.when(full, wall))
    timed = timed.withColumn("_wall", _clamped(F.col("_wall"), F.col("_two") | F.col("_y").isNull()))
    own = F.when(F.col("_wall").isNotNull(), tp.to_utc(F.col("_wall"), F.col("_zone")))
    timed = timed.withColumn("_own", own)
    # Whether any matched line came before decides between "carried" and "synthetic".
    held = carry(timed, {"_last": F.col("_own")}, before={"_seen": F.when(F.col("matched"), 1)})
    label = (
        F.when(F.col("_own").isNotNull(), F.when(F.col("_inferred"), "inferred").otherwise("exact"))
        .when(F.col("_last").isNotNull() | F.col("_seen").isNotNull(), "carried")
        .otherwise("synthetic")
    )
    out = held.withColumns(
        {"timestamp": F.coalesce("_last", "_anchor"), "ts_confidence": label, "ts_zone": F.lit("+00:00")}
    )
    return out.drop("_wall", "_own", "_last", "_seen")


def _offset_of_line() -> Column:
    """Seconds east of UTC of a line's zone; a named zone's are those of its rules on the line's day.

    What the line leaves out of its day is taken from the anchor, which only matters within a
    day of a change of the clocks.
    """
    wall = tp.wall_micros(
        F.coalesce("_y", utc.year("_anchor")),
        F.coalesce("_mo", utc.month("_anchor")),
        F.coalesce("_d", utc.day("_anchor")),
        F.coalesce("_tod", F.lit(0).cast("bigint")),
    )
    fixed = F.col("_zone").rlike(r"^[+-]\d\d:\d\d$")
    named = ((wall - F.unix_micros(tp.to_utc(wall, F.col("_zone")))) / 1_000_000).cast("int")
    return F.when(fixed, tp.offset_seconds(F.col("_zone"))).otherwise(F.coalesce(named, F.lit(0)))


def _line_parts() -> dict[str, Column]:
    """What the clock of a source needs to know of a line."""
    return {
        "y": F.col("_y"),
        "mo": F.col("_mo"),
        "d": F.col("_d"),
        "tod": F.col("_tod"),
        "off": _offset_of_line(),
        "zone": F.col("_zone"),
        "two": F.col("_two"),
        "inferred": F.col("_inferred"),
        "anchor": F.unix_micros("_anchor"),
        "rollover": F.col("_rollover"),
    }


def _resolve_running(df: DataFrame) -> DataFrame:
    """Follow the clock of each source: by sums or held values where its lines allow it (``clock``), else line by line (``recurrence``).

    One small row per block is written to the checkpoint folder first; which kinds of source there are, four at most,
    is known from it before the rows are looked at.
    """
    parts = _line_parts()
    lines = df.select(*KEY, "line_no", "matched", *(value.alias(name) for name, value in parts.items()))
    states = settle(clock.entering(clock.block_marks(lines)))
    kinds = {r[0] for r in states.select("_kind").distinct().collect()}
    branches = []
    if kinds != {clock.OTHER}:
        branches.append(clock.resolve_sums(df, parts, states.filter(F.col("_kind") != clock.OTHER), kinds))
    if clock.OTHER in kinds:
        left = states.filter(F.col("_kind") == clock.OTHER).select(*KEY)
        branches.append(_resolve_by_line(df if len(kinds) == 1 else join_blocks(df, left), parts))
    return reduce(DataFrame.unionByName, branches)


def _resolve_by_line(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Sources whose lines lean on each other in other ways; blocks are composed in runs of bounded length."""
    lines = df.select(*KEY, "line_no", "matched", *(value.alias(name) for name, value in parts.items()))
    # Python work is heavy for its bytes, so the number of tasks is fixed rather than left to
    # be reduced by size.
    lines = lines.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    blocks = settle(lines.groupBy(*KEY).applyInArrow(block_summary, "_src string, block long, summary string"))
    runs = max(1, -(-blocks.count() // RUN_BLOCKS))
    # Neighbouring blocks fall into one run; the written table keeps which.
    ranged = settle(blocks.repartitionByRange(runs, "_src", "block").withColumn("run", F.spark_partition_id()))
    summaries = ranged.groupBy("_src", "run").applyInArrow(run_summary, "_src string, run int, block long, summary string")
    into_runs = summaries.groupBy("_src").applyInArrow(entering_times, "_src string, block long, run int, in_wall long, in_off long, in_zone string")
    entered = ranged.join(into_runs.drop("block"), ["_src", "run"])
    entering = entered.groupBy("_src", "run").applyInArrow(entering_blocks, "_src string, block long, in_wall long, in_off long, in_zone string")
    times = (
        join_blocks(lines, entering)
        .groupBy(*KEY)
        .applyInArrow(
            block_times, "_src string, block long, line_no long, wall long, zone string, ts_confidence string"
        )
    )
    moment = tp.to_utc(F.col("wall"), F.col("zone"))
    times = times.select(*KEY, "line_no", moment.alias("timestamp"), "ts_confidence", F.col("zone").alias("ts_zone"))
    return df.join(times, [*KEY, "line_no"])


def resolve(
    df: DataFrame,
    cfg: TimeConfig | None = None,
    profile: DataFrame | None = None,
    lead_field: str = "",
    modes: set[str] | None = None,
    hints: Sequence[Pattern] = (),
    cut: bool = False,
) -> DataFrame:
    """Add ``timestamp`` and ``ts_confidence`` (exact, inferred, carried, synthetic).

    Needs ``_src, block, line_no, attrs, matched``.  With a ``profile`` (see
    ``profile_time``) every source gets its own anchor, rollover and source field; the
    config's forced parts and zone still apply to all.  A row with ``lead_field`` in its
    ``attrs`` states a time as it is (UTC microseconds, a bar, and the zone), for work that
    goes on from an earlier batch; ``ts_zone`` is then added too.  ``modes`` (see
    ``modes_of``) leaves out the kinds of source the profile does not have; without them the profile is
    written to the checkpoint folder and asked.  ``hints`` are
    the patterns that the rows' ``pattern`` names; a pattern's time field and layout are
    used for the rows it matched.  The rows are read more than once; with ``cut`` they are
    written to the checkpoint folder with the time that each says, so no line is parsed twice.
    """
    cfg = cfg or TimeConfig(anchor=dt.datetime.now(dt.timezone.utc))
    inner = settle_keys(df.drop("timestamp", "ts_confidence"))
    if profile is not None:
        if modes is None:
            profile = settle(profile)
            modes = modes_of(profile)
        settings = profile.select(
            F.coalesce("_src", F.lit(NO_SOURCE)).alias("_src"),
            F.col("anchor").alias("_anchor"),
            F.col("rollover").alias("_rollover"),
            (F.col("dated") if "dated" in profile.columns else ~F.col("rollover")).alias("_dated"),
            (F.col("status") == "missing").alias("_synthetic"),
            F.col("source_field").alias("_field"),
        )
        # A row per source: few hold all rows, so rows stay where they are unless the sources are very many.
        few = settings.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        inner = inner.join(F.broadcast(settings) if few else settings, "_src")
        inner = extract_parts(inner, F.coalesce("_field", F.lit("")), hints=hints)
        inner = _line_columns(inner, cfg)
        if lead_field:
            inner = _lead(inner, F.split(F.col("attrs")[lead_field], r"\|"))
        inner = settle_rows(inner) if cut else inner
        branches = {
            "dated": lambda d: settle_keys(_resolve_dated(d.filter("not _synthetic and _dated"))),
            "running": lambda d: _resolve_running(d.filter("not _synthetic and not _dated")),
            "synthetic": lambda d: settle_keys(_synthetic(d.filter("_synthetic"))),
        }
        wanted = [build(inner) for mode, build in branches.items() if mode in modes]
        out = reduce(DataFrame.unionByName, wanted)
    else:
        anchor = F.col(cfg.anchor_column) if cfg.anchor_column else F.timestamp_micros(F.lit(micros(cfg.anchor)))
        inner = inner.withColumns({"_anchor": anchor, "_rollover": F.lit(cfg.rollover)})
        if cfg.synthetic:
            out = _synthetic(inner)
        else:
            inner = _line_columns(extract_parts(inner, cfg.source_field, cfg.source_format, hints), cfg)
            inner = settle_rows(inner) if cut else inner
            out = _resolve_dated(inner) if cfg.dated and not cfg.rollover else _resolve_running(inner)
    helper = ("_anchor", "_rollover", "_dated", "_synthetic", "_field", "_y", "_mo", "_d", "_tod", "_zone", "_two", "_inferred")
    out = restore_keys(out)
    return out.drop(*helper) if lead_field else out.drop(*helper, "ts_zone")


def modes_of(profile: DataFrame) -> set[str]:
    """Kinds of source in a profile: at most three values, worth knowing before planning."""
    dated = F.col("dated") if "dated" in profile.columns else ~F.col("rollover")
    mode = F.when(F.col("status") == "missing", "synthetic").when(dated, "dated").otherwise("running")
    return {r[0] for r in profile.select(mode).distinct().collect()} or {"dated"}


def _lead(df: DataFrame, stated: Column) -> DataFrame:
    """Rows that state their time stand for a full date in the stated zone."""
    us, zone = F.get(stated, 0).try_cast("bigint"), F.get(stated, 1)
    at = F.from_utc_timestamp(F.timestamp_micros(us), zone)
    parts = {
        "_y": utc.year(at),
        "_mo": utc.month(at),
        "_d": utc.day(at),
        "_tod": utc.time_of_day(at),
        "_zone": zone,
        "_two": F.lit(False),
        "_inferred": F.lit(False),
    }
    return df.withColumns({c: F.when(us.isNotNull(), v).otherwise(F.col(c)) for c, v in parts.items()})


def _synthetic(df: DataFrame) -> DataFrame:
    """No line has a time: the anchor plus one microsecond per line."""
    numbered = with_seq(df, "_tick")
    moment = F.timestamp_micros(F.unix_micros("_anchor") + F.col("_tick"))
    return numbered.withColumns(
        {"timestamp": moment, "ts_confidence": F.lit("synthetic"), "ts_zone": F.lit("+00:00")}
    ).drop("_tick")


def _date_year_width(text: Column) -> Column:
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\d{8}$"), 4)
        .when(t.rlike(r"^\d+(?:-[^-]*-[^-]*|/[^/]*/[^/]*|\.[^.]*\.[^.]*)$"), F.length(F.regexp_extract(t, r"^\d+", 0)))
        .otherwise(0)
    )


def time_candidates(df: DataFrame) -> DataFrame:
    """Other fields that may hold the time, best first: ``_src, name, sample, parses, format, score, rank``."""
    at = F.struct("block", "line_no")
    pairs = df.filter("matched").select("_src", at.alias("at"), F.explode("attrs").alias("name", "value"))
    pairs = pairs.filter(~F.col("name").isin(*TIME_FIELDS) & (F.trim("value") != ""))
    samples = pairs.groupBy("_src", "name").agg(F.min_by(F.trim("value"), F.col("at")).alias("sample"))
    parsed = tp.with_parsed_ts(samples, "p", F.col("sample"))
    lower = F.lower("name")
    hint = (
        F.when(lower.contains("timestamp") | lower.endswith("_ts") | lower.endswith("_at"), 10)
        .when(lower.isin("time", "date") | lower.endswith("_time") | lower.endswith("_date"), 5)
        .otherwise(0)
    )
    year = F.when(F.coalesce(F.col("p.y"), F.lit(0)) != 0, 5).otherwise(0)
    fraction = F.when(F.col("p.tod") % 1_000_000 != 0, 1).otherwise(0)
    parses = F.col("p").isNotNull()
    digits = F.when(F.col("sample").rlike(r"^\d+$"), F.length("sample"))
    layout = F.when(digits == 10, "unix_seconds").when(digits == 13, "unix_millis").when(
        digits.isin(16, 19), "unix_nanos"
    ).otherwise("auto")
    scored = parsed.withColumns(
        {
            "parses": parses,
            "format": F.when(parses, layout),
            "score": F.when(parses, 1 + hint + year + fraction).otherwise(0),
            "parsed": F.when(
                parses & F.col("p.y").isNotNull(),
                tp.to_utc(tp.wall_micros(F.col("p.y"), F.col("p.mo"), F.col("p.d"), F.col("p.tod")), F.col("p.zone")),
            ),
        }
    ).drop("p")
    best_first = Window.partitionBy("_src").orderBy(F.desc("score"), F.asc("name"))
    return scored.withColumn("rank", F.row_number().over(best_first))


def _with_stamp(attrs: Column) -> Column:
    """Fields that certainly have a ``timestamp``."""
    stamp = F.coalesce(F.nullif(F.trim(attrs["timestamp"]), F.lit("")), F.lit("hinted"))
    return F.map_concat(F.map_filter(attrs, lambda k, v: k != "timestamp"), F.create_map(F.lit("timestamp"), stamp))


def profile_time(df: DataFrame, mtime: Column | None = None, now: dt.datetime | None = None, hints: Sequence[Pattern] = ()) -> DataFrame:
    """What the fields of each source say about time, in one row per source.

    Columns: ``status`` (exact, inferred, missing), ``components``, ``year_width``,
    ``anchor_kind``, ``anchor``, ``year_strategy``, ``rollover``, ``source_field``,
    ``source_format``, ``warning``, ``dated``.  ``mtime`` is the source file's time if known.
    Only a source whose every timed line carries a full date is ``dated``; in any other, lines
    borrow what they lack from the line before.  With ``hints`` the time that a row's pattern
    names counts as its timestamp.
    """
    moment = now or dt.datetime.now(dt.timezone.utc)
    rows = tp.with_parsed_ts(df, "p", F.when(F.col("matched"), _text("timestamp")))
    rows = with_hinted(rows, hints)
    if "_said" in rows.columns:
        rows = rows.withColumn("p", F.when(F.col("matched"), F.coalesce("_said", "p")))
        rows = rows.withColumn("attrs", F.when(F.col("p").isNotNull(), _with_stamp(F.col("attrs"))).otherwise(F.col("attrs")))
    full = F.when(
        F.coalesce(F.col("p.y"), F.lit(0)) != 0,
        tp.to_utc(tp.wall_micros(F.col("p.y"), F.col("p.mo"), F.col("p.d"), F.col("p.tod")), F.col("p.zone")),
    )
    rows = rows.withColumns({"full": full, "mtime": mtime if mtime is not None else F.lit(None).cast("timestamp")})
    year_width = F.greatest(
        F.coalesce(F.length(_text("year")), F.lit(0)),
        F.coalesce(_date_year_width(_text("date")), F.lit(0)),
        F.when(F.col("full").isNotNull(), 4).otherwise(0),
    )
    part = lambda name: F.coalesce(F.col(f"p.{name}"), F.lit(0)) == 0
    timed = _text("time").isNotNull() | _text("hour").isNotNull()
    whole_date = (_date_year_width(_text("date")) >= 4) | ((F.length(_text("year")) >= 4) & _text("month").isNotNull() & _text("day").isNotNull())
    lacking = F.when(_text("timestamp").isNotNull(), F.col("p").isNotNull() & (part("y") | part("mo") | part("d"))).otherwise(
        timed & ~F.coalesce(whole_date, F.lit(False))
    )
    # Block by block first, so that all values are numbers and rows are hashed, not sorted by source.
    place = {c: F.coalesce(c, F.lit(NO_BLOCK)) for c in ("block", "line_no")}
    of_blocks = rows.groupBy("_src", place["block"].alias("block")).agg(
        F.count_if(F.col("matched") & lacking).alias("lacking"),
        F.max(year_width).alias("year_width"),
        F.min_by("full", F.when(F.col("full").isNotNull(), place["line_no"])).alias("first_full"),
        F.max("mtime").alias("mtime"),
        *[F.max(F.col("matched") & _text(k).isNotNull()).alias(f"has_{k}") for k in TIME_FIELDS],
    )
    stats = of_blocks.groupBy("_src").agg(
        F.sum("lacking").alias("lacking"),
        F.max("year_width").alias("year_width"),
        F.min_by("first_full", F.when(F.col("first_full").isNotNull(), F.col("block"))).alias("first_full"),
        F.max("mtime").alias("mtime"),
        *[F.max(f"has_{k}").alias(f"has_{k}") for k in TIME_FIELDS],
    )
    stats = stats.withColumns({f"has_{k}": F.when(F.col(f"has_{k}"), F.lit(k)) for k in TIME_FIELDS})
    best = time_candidates(df).filter((F.col("rank") == 1) & F.col("parses"))
    best = best.select("_src", F.col("name").alias("best"), F.col("format").alias("best_format"), "parsed")
    stats = stats.join(best, "_src", "left")

    has = {k: F.col(f"has_{k}").isNotNull() for k in TIME_FIELDS}
    own_time = has["timestamp"] | has["time"] | has["hour"]
    picked = ~own_time & F.col("best").isNotNull()
    picked_full = picked & F.col("parsed").isNotNull()
    first = F.coalesce(F.col("first_full"), F.when(picked_full, F.col("parsed")))
    width = F.when(picked_full, 4).otherwise(F.col("year_width"))
    kind = F.when(F.col("mtime").isNotNull(), "file_mtime").when(first.isNotNull(), "first_parsed").otherwise("now")
    anchor = F.coalesce("mtime", first, F.timestamp_micros(F.lit(micros(moment))))
    strategy = F.when(width >= 4, "parsed").when(F.col("year_width") == 2, "inferred_century").otherwise("from_anchor")
    status = (
        F.when(~own_time & ~picked, "missing").when(picked, "inferred").when(width >= 4, "exact").otherwise("inferred")
    )
    year_text = F.lpad(utc.year(anchor).cast("string"), 4, "0")
    warning = (
        F.when(~own_time & ~picked, "no time fields found; every line is stamped from the anchor")
        .when(picked, F.concat(F.lit("time is taken from field "), F.col("best")))
        .when(width >= 4, None)
        .when(F.col("year_width") == 2, F.concat(F.lit("two-digit year expanded by the "), kind, F.lit(" anchor")))
        .otherwise(F.concat(F.lit("year "), year_text, F.lit(" borrowed from the "), kind, F.lit(" anchor")))
    )
    return stats.select(
        "_src",
        status.alias("status"),
        F.array_sort(F.array_compact(F.array(*[F.col(f"has_{k}") for k in TIME_FIELDS]))).alias("components"),
        width.alias("year_width"),
        kind.alias("anchor_kind"),
        anchor.alias("anchor"),
        strategy.alias("year_strategy"),
        (~((F.col("year_width") >= 4) & (has["timestamp"] | has["date"]))).alias("rollover"),
        F.when(picked, F.col("best")).alias("source_field"),
        F.when(picked & (F.col("best_format") != "auto"), F.col("best_format")).alias("source_format"),
        warning.alias("warning"),
        ((F.col("year_width") >= 4) & (has["timestamp"] | has["date"]) & (F.col("lacking") == 0)).alias("dated"),
    )


def time_quality(df: DataFrame) -> DataFrame:
    """Rows per source and confidence."""
    return df.groupBy("_src", "ts_confidence").agg(F.count(F.lit(1)).alias("count"))


def time_examples(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows per source and confidence, captured parts beside the resolved text.

    The rank filter is applied per task before the shuffle, so hot groups stay spread out.
    """
    first = Window.partitionBy("_src", "ts_confidence").orderBy("block", "line_no")
    captured = F.map_filter("attrs", lambda k, v: k.isin(*TIME_FIELDS) & (v != ""))
    return (
        df.withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= n)
        .select(
            "_src",
            "ts_confidence",
            "n",
            "_raw",
            captured.alias("captured"),
            utc.text("timestamp", 3).alias("resolved"),
        )
    )
