"""Row counts over time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.functions import utc
from brooklog.model import micros, moment

MAX_BUCKETS = 100
SECOND = 1_000_000


def bucket_count(start: dt.datetime, end: dt.datetime) -> int:
    """One bucket per started second, at most 100."""
    span = micros(end) - micros(start) + 1
    return max(1, min(MAX_BUCKETS, -(-span // SECOND)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def bucket_of(start: dt.datetime, end: dt.datetime, ts: str | Column = "timestamp") -> Column:
    """Bucket number of a row of the window; integer arithmetic throughout."""
    n, lo = bucket_count(start, end), micros(start)
    span = max(1, micros(end) - lo + 1)
    col = F.col(ts) if isinstance(ts, str) else ts
    return _div((F.unix_micros(col) - F.lit(lo)) * F.lit(n), F.lit(span))


def _frame(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """All buckets of the window with their bounds; at most 100 rows."""
    n, lo = bucket_count(start, end), micros(start)
    span = max(1, micros(end) - lo + 1)

    def edge(i: Column) -> Column:
        return F.lit(lo) + _div(i * F.lit(span) + F.lit(n - 1), F.lit(n))

    return df.sparkSession.range(0, n, 1, 1).select(
        F.col("id").alias("bucket"),
        F.timestamp_micros(edge(F.col("id"))).alias("bucket_start"),
        F.timestamp_micros(edge(F.col("id") + 1)).alias("bucket_end"),
    )


def distribution(
    df: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    sources: Sequence[str] | None = None,
) -> DataFrame:
    """Counts per bucket of [start, end], empty buckets included.

    With ``sources`` each bucket also gets the counts of those sources.  Rows are
    pre-aggregated per task, so the shuffle carries at most buckets x sources rows per task.
    """
    inside = df.filter(F.col("timestamp").between(moment(start), moment(end)))
    rows = inside.select(bucket_of(start, end).alias("bucket"), "_src")
    counted = F.count(F.lit(1))
    if not sources:
        counts = rows.groupBy("bucket").agg(counted.alias("n"))
        split = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
        joined = _frame(df, start, end).join(F.broadcast(counts), "bucket", "left")  # <= 100 rows
        return joined.select(
            "bucket", "bucket_start", "bucket_end", F.coalesce("n", F.lit(0)).alias("count"), split.alias("source_counts")
        )
    asked = list(dict.fromkeys(sources))
    per_source = rows.groupBy("bucket", "_src").agg(counted.alias("n"))
    shown = F.when(F.col("_src").isin(asked), F.struct("_src", "n"))
    counts = per_source.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(shown))).alias("split")
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    joined = _frame(df, start, end).join(F.broadcast(counts), "bucket", "left")  # <= 100 rows
    return joined.select(
        "bucket",
        "bucket_start",
        "bucket_end",
        F.coalesce("n", F.lit(0)).alias("count"),
        F.coalesce("split", none).alias("source_counts"),
    )


def distribution_by_source(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Non-empty (bucket, source) counts as rows, for any number of sources."""
    inside = df.filter(F.col("timestamp").between(moment(start), moment(end)))
    return inside.groupBy(bucket_of(start, end).alias("bucket"), "_src").agg(F.count(F.lit(1)).alias("count"))


def distribution_auto(df: DataFrame) -> DataFrame:
    """Non-empty (bucket, source) counts over the span of the data itself.

    Bucket width is a hundredth of the span but no less than a second; the last row
    belongs to the last bucket.  The span is a scalar subquery, not a join.
    """
    rows = df.select(F.unix_micros("timestamp").alias("us"), F.coalesce("_src", F.lit("unknown")).alias("_src"))
    rows = rows.filter(F.col("us").isNotNull())
    span = rows.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    span = span.withColumn("span", (F.col("hi") - F.col("lo")) * 1000)
    width = F.greatest(_div(F.col("span"), F.lit(MAX_BUCKETS)), F.lit(1000 * SECOND))
    span = span.withColumn(
        "n", F.least(F.greatest(_div(F.col("span"), width), F.lit(1)), F.lit(MAX_BUCKETS))
    ).withColumn("width", F.greatest(_div(F.col("span"), F.col("n")), F.lit(1)))
    frame = span.select(F.struct("lo", "hi", "n", "width")).scalar()
    at = _div((F.col("us") - frame["lo"]) * 1000, frame["width"])
    bucket = F.when(F.col("us") == frame["hi"], frame["n"] - 1).otherwise(F.least(at, frame["n"] - 1))
    start = frame["lo"] + _div(F.col("bucket") * frame["width"], F.lit(1000))
    counts = rows.groupBy(bucket.cast("long").alias("bucket"), "_src").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bucket", F.timestamp_micros(start).alias("bucket_start"), "_src", "count")


def drill(df: DataFrame, start: dt.datetime, end: dt.datetime, i: int, j: int) -> tuple[dt.datetime, dt.datetime, DataFrame]:
    """The window covered by buckets ``i`` to ``j`` (any direction) and its own histogram."""
    n, lo = bucket_count(start, end), micros(start)
    span = micros(end) - lo + 1
    first, last = min(i, j), max(i, j)
    if first < 0 or last >= n:
        raise ValueError(f"buckets run from 0 to {n - 1}")
    zone = start.tzinfo

    def at(us: int) -> dt.datetime:
        """The moment in the caller's zone; added up in UTC, where every hour has the same length."""
        moment = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)
        return moment.astimezone(zone) if zone else moment.replace(tzinfo=None)

    from_us = lo - (-first * span // n)
    upto_us = lo - (-(last + 1) * span // n)
    new_start, new_end = at(from_us), at(upto_us - 1)
    return new_start, new_end, distribution(df, new_start, new_end)


def fit_window(df: DataFrame) -> DataFrame:
    """The days that hold data, widened by one day on both sides: one row (start, end)."""
    edge = df.agg(F.min("log_date").alias("lo"), F.max("log_date").alias("hi"))
    return edge.select(
        utc.midnight(F.date_sub("lo", 1)).alias("start"),
        F.timestamp_micros(F.unix_micros(utc.midnight(F.date_add("hi", 2))) - SECOND).alias("end"),
    )
