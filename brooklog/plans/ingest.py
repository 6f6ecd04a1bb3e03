"""From raw lines to stored rows: fold, extract, resolve, number, store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions.grok import DEFAULT, Pattern
from brooklog.operators import extract as ex
from brooklog.operators import fold as fo
from brooklog.operators import ordering, timeres
from brooklog.session import settle
from brooklog.sources import lines as li
from brooklog.sources import store


@dataclass(frozen=True)
class IngestOptions:
    """How to read a set of files.

    ``time`` fixes the time settings; without it every source is profiled.  ``source``
    names all rows, ``file_names`` shortens paths to file names; ids keep the full path.
    With ``choose`` every source is parsed by the one of ``patterns`` that fits most of its
    lines.  A pattern's time field and layout say where its lines have their time.
    """

    pattern: str = DEFAULT
    custom_patterns: Mapping[str, str] = field(default_factory=dict)
    name: str = ""
    patterns: Sequence[Pattern] = ()
    choose: bool = False
    fold_mode: str = "off"
    fold_header: str | None = None
    max_lines: int = fo.MAX_LINES
    max_bytes: int = fo.MAX_BYTES
    time: timeres.TimeConfig | None = None
    smart: bool = False
    meta: Mapping[str, object] = field(default_factory=dict)
    source: str | None = None
    file_names: bool = False


def parse(lines: DataFrame, opts: IngestOptions) -> DataFrame:
    """Lines to records with fields; nothing here looks at other records."""
    keep = [c for c in ("source_mtime",) if c in lines.columns]
    records = fo.fold(lines, opts.fold_mode, opts.fold_header, opts.max_lines, opts.max_bytes, keep)
    patterns = list(opts.patterns) or [Pattern(opts.name, opts.pattern, custom_patterns=opts.custom_patterns)]
    parsed = ex.extract_suggested(records, patterns) if opts.choose else ex.extract_first(records, patterns)
    return ex.smart_decode(parsed) if opts.smart else parsed


def finish(resolved: DataFrame, opts: IngestOptions) -> DataFrame:
    """Sequence, meta, id and day of resolved records, in the order later steps override earlier ones."""
    rows = resolved if "_seq" in resolved.columns else ordering.with_seq(resolved)
    rows = rows.withColumn("source", F.col("_src"))
    if opts.source:
        rows = rows.withColumn("_src", F.lit(opts.source))
    elif opts.file_names:
        rows = li.with_file_name(rows)
    rows = ex.with_meta(rows, opts.meta) if opts.meta else rows
    rows = rows.withColumn("attrs", F.map_filter("attrs", lambda k, v: k != "timestamp"))
    rows = model.with_log_date(model.with_row_id(rows, "source"))
    extra = [c for c in ex.SMART if c in rows.columns]
    return rows.select(
        "timestamp", "log_date", "_raw", "_src", "_seq", "_id", "error", "attrs", "ts_confidence", *extra
    )


def to_rows(lines: DataFrame, opts: IngestOptions, now: dt.datetime | None = None, cut: bool = False) -> DataFrame:
    """Lines to log rows.

    Time resolution reads the parsed records more than once, so they are written to the
    checkpoint folder with the time that each says.  ``cut`` also writes them before a profile
    is taken, which pays off when the lines are large text files.
    """
    records = parse(lines, opts)
    if cut and opts.time is None:
        records = settle(records)
    if opts.time is not None:
        resolved = timeres.resolve(records, opts.time, hints=opts.patterns, cut=True)
    else:
        mtime = F.col("source_mtime") if "source_mtime" in records.columns else None
        profile = timeres.profile_time(records, mtime, now, opts.patterns)
        profile = settle(profile)  # a row per source; the plan leaves out the kinds of source it does not have
        resolved = timeres.resolve(records, profile=profile, modes=timeres.modes_of(profile), hints=opts.patterns, cut=True)
    return finish(resolved, opts)


def ingest(spark: SparkSession, paths: str | Sequence[str], opts: IngestOptions, out: str) -> DataFrame:
    """Read files, store their rows under ``out`` and return the parse summary per source.

    A line above the size limit stops the ingest, as nothing may be cut off silently.
    """
    lines = li.read_lines(spark, paths)
    lines = lines.withColumn(
        "line",
        F.when(
            F.octet_length("line") > li.MAX_LINE_BYTES, F.raise_error(F.lit("a log line exceeds the 2 MiB limit"))
        ).otherwise(F.col("line")),
    )
    if opts.source is None:
        opts = replace(opts, file_names=True)
    rows = settle(to_rows(lines, opts, cut=True))
    store.append(rows, out)
    return rows.groupBy("_src").agg(
        F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )


def preview(lines: DataFrame, opts: IngestOptions, now: dt.datetime | None = None) -> DataFrame:
    """The rows an ingest would store, without the internal sequence; nothing is stored."""
    return to_rows(lines, opts, now).drop("_seq")
