"""Many saved views over one log table in one scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.functions import predicates as q
from brooklog.functions.relative import window_of
from brooklog.operators import display, paging, tagging
from brooklog.operators.histogram import bucket_of

#: Views tested side by side in one scan; more go in further scans.
VIEWS_PER_SCAN = 200


@dataclass(frozen=True)
class View:
    """A saved search: predicate, sources, window, order, columns and rules.

    The window is relative (``preset``, or ``count`` and ``unit``) or absolute (``start``, ``end``).
    """

    id: str
    where: Column | None = None
    sources: tuple[str, ...] = ()
    preset: str | None = "last-24-hours"
    count: int | None = None
    unit: str | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    sort_by: str = "timestamp"
    order: str = "desc"
    columns: tuple[str, ...] = ()
    rules: tuple[tagging.Rule, ...] = field(default_factory=tuple)

    def window(self, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
        if self.start or self.end:
            return self.start or now - dt.timedelta(days=1), self.end or now
        return window_of(now, self.preset, self.count, self.unit)

    def test(self, now: dt.datetime, prune: bool = True) -> Column:
        test = q.in_window(*self.window(now), prune=prune)
        if self.sources:
            test &= q.from_sources(self.sources)
        return test if self.where is None else test & self.where


def _hits(df: DataFrame, views: Sequence[View], now: dt.datetime) -> DataFrame:
    """One row per (row, matching view).  The scan itself is bounded by the union of the windows."""
    if len({v.id for v in views}) < len(views):
        raise ValueError("each view needs its own id")
    if len(views) > VIEWS_PER_SCAN:
        groups = [views[i : i + VIEWS_PER_SCAN] for i in range(0, len(views), VIEWS_PER_SCAN)]
        return reduce(DataFrame.unionByName, [_hits(df, g, now) for g in groups])
    windows = [v.window(now) for v in views]
    lo, hi = min(w[0] for w in windows), max(w[1] for w in windows)
    hits = [
        F.when(v.test(now, prune=False), F.struct(F.lit(v.id).alias("view_id"), bucket_of(*v.window(now)).alias("bucket")))
        for v in views
    ]
    rows = df.filter(q.in_window(lo, hi)).withColumn("_hits", F.array_compact(F.array(*hits)))
    return rows.select("timestamp", F.explode("_hits").alias("h")).select("h.view_id", "h.bucket", "timestamp")


def view_histograms(df: DataFrame, views: Sequence[View], now: dt.datetime) -> DataFrame:
    """Non-empty buckets of all views: ``view_id, bucket, count, first_ts, last_ts``."""
    return _hits(df, views, now).groupBy("view_id", "bucket").agg(
        F.count(F.lit(1)).alias("count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


def run_views(df: DataFrame, views: Sequence[View], now: dt.datetime) -> DataFrame:
    """Per view: count, first and last time, and its histogram (bucket -> count, at most 100 entries).

    A view that shows nothing has a count of 0, no times and an empty histogram.
    """
    entry = F.struct("bucket", "count")
    shown = view_histograms(df, views, now).groupBy("view_id").agg(
        F.sum("count").alias("count"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("histogram"),
    )
    asked = df.sparkSession.createDataFrame([(v.id,) for v in views], "view_id string")
    nothing = F.map_from_entries(F.array().cast("array<struct<k:bigint,v:bigint>>"))
    return asked.join(shown, "view_id", "left").withColumns(
        {"count": F.coalesce("count", F.lit(0).cast("long")), "histogram": F.coalesce("histogram", nothing)}
    )


def view_page(df: DataFrame, view: View, now: dt.datetime, limit: int = 100, offset: int = 0) -> DataFrame:
    """The page of one view, tagged by its rules and cut to its columns."""
    rows = paging.page(df.filter(view.test(now)), limit, offset, view.order, view.sort_by)
    if view.rules:
        rows = tagging.tag(rows, view.rules)
    if not view.columns:
        return rows
    tags = ["tag", "tag_rule"] if view.rules else []
    return display.select_columns(rows, [*view.columns, *tags])
