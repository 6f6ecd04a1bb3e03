"""Counts and overviews of a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brooklog import model

OTHER = "other"

# How useful a field is in a log table, by name.
FIELD_PRIORITY = {
    100: ("message", "msg"),
    95: ("level", "severity", "log_level"),
    90: ("status", "status_code", "http_status", "response_status"),
    85: ("method", "verb", "http_method"),
    80: ("url", "path", "request", "uri"),
    75: ("host", "hostname"),
    70: ("service", "program", "app", "component"),
    65: ("client_ip", "remote_addr", "src_ip"),
    60: ("user_agent", "agent"),
    55: ("user", "user_id", "username"),
    50: ("duration", "latency", "response_time", "elapsed"),
    45: ("bytes", "size", "content_length"),
    40: ("referrer", "referer"),
    5: ("auth", "ident"),
}
OTHER_FIELD_PRIORITY = 30


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def source_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("_src").agg(F.count(F.lit(1)).alias("count"))


def source_names(df: DataFrame) -> DataFrame:
    return df.select("_src").filter(F.col("_src").isNotNull()).distinct()


def day_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("log_date").agg(F.count(F.lit(1)).alias("count"))


def top_sources(df: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` largest sources by name and the rest as one row.

    The top list is a bounded top-k, so it is safe to broadcast; no task ranks all sources.
    """
    counts = source_totals(df).withColumn("_src", F.coalesce("_src", F.lit("unknown")))
    top = counts.orderBy(F.desc("count"), F.asc("_src")).limit(k).select(F.col("_src").alias("name"))
    joined = counts.join(F.broadcast(top), F.col("_src") == F.col("name"), "left")
    label = F.coalesce(F.col("name"), F.lit(OTHER))
    is_top = F.col("name").isNotNull()
    return (
        joined.groupBy(label.alias("source"), is_top.alias("is_top"))
        .agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("n_sources"))
        .select("source", "is_top", "count", "n_sources")
    )


def _present_columns(df: DataFrame) -> list[str]:
    hidden = ("attrs", "_seq", "log_date", "block", "line_no", "source", "ts_confidence", "matched")
    return [c for c in df.columns if c not in hidden]


def available_columns(df: DataFrame) -> DataFrame:
    """Names of all fields that occur, one per row; the internal sequence stays hidden."""
    core = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in _present_columns(df)])
    names = F.array_compact(core)
    if "attrs" in df.columns:
        names = F.concat(names, F.coalesce(F.map_keys("attrs"), F.array().cast("array<string>")))
    # Rows of one source mostly share their field set: dedupe the sets before exploding them.
    sets = df.select(F.array_sort(names).alias("names")).distinct()
    return sets.select(F.explode("names").alias("column")).filter(F.col("column") != "_seq").distinct()


def facets(df: DataFrame, fields: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each field: (field, value, count, rank).

    The rank filter is pushed below the shuffle as a per-task group limit, so a field
    with a huge number of values does not land in one task.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), model.field(f).cast("string").alias("value")) for f in fields])
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.field", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    by_count = Window.partitionBy("field").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= k)


def _priority(name: Column) -> Column:
    lower = F.lower(name)
    score = F.lit(OTHER_FIELD_PRIORITY)
    for value, names in FIELD_PRIORITY.items():
        score = F.when(lower.isin(*names), value).otherwise(score)
    return score


def column_fill(df: DataFrame) -> DataFrame:
    """Per field, rows with a real value (missing, blank and ``-`` do not count), and its priority.

    ``error`` is a field like those in ``attrs``.
    """
    value = F.col("value")
    own = F.map_filter("attrs", lambda k, v: k != "error")
    stated = F.coalesce(F.col("error"), F.col("attrs")["error"], F.lit("")) if "error" in df.columns else F.coalesce(F.col("attrs")["error"], F.lit(""))
    fields = F.map_concat(F.coalesce(own, F.create_map().cast("map<string,string>")), F.create_map(F.lit("error"), stated))
    real = F.count_if((F.trim(value) != "") & (value != "-"))
    return (
        df.select(F.explode(fields).alias("column", "value"))
        .filter(~F.col("column").startswith("_") & (F.col("column") != "timestamp"))
        .groupBy("column")
        .agg(real.alias("filled"))
        .withColumn("priority", _priority(F.col("column")))
    )


def default_columns(df: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` fields to show first: filled ones, then by priority, then by name."""
    empty = F.col("filled") == 0
    return column_fill(df).orderBy(empty, F.desc("priority"), F.asc("column")).limit(k)
