"""Shape of a log row.

A log DataFrame has a few fixed columns plus ``attrs``, a map with the fields that
differ from row to row.  ``(_src, block, line_no)`` gives the order of rows inside a
source: ``block`` is a bounded run of consecutive lines (a file split, or a fixed
number of rows) and ``line_no`` increases inside the block.  Every ordered operator
works block by block and joins up the blocks through one summary row each, so a
source of any size is spread over many tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklog.functions import utc

CORE_COLUMNS = ("timestamp", "log_date", "_raw", "_src", "_seq", "_id", "error", "source", "block", "line_no")
ORDER = ("block", "line_no")

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("log_date", T.DateType()),
        T.StructField("_raw", T.StringType()),
        T.StructField("_src", T.StringType()),
        T.StructField("_seq", T.LongType()),
        T.StructField("_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts_confidence", T.StringType()),
        *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("_ipv4_addr", "_email_addr", "_urls", "_mac_addr", "_uuids")),
    ]
)


def micros(at: dt.datetime) -> int:
    """Microseconds since the epoch; a naive datetime is UTC."""
    aware = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return (aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def moment(at: dt.datetime) -> Column:
    """A constant timestamp that does not depend on the driver's own time zone."""
    return F.timestamp_micros(F.lit(micros(at)))


def in_utc(at: dt.datetime) -> dt.datetime:
    """The same moment in UTC; a naive datetime is UTC already."""
    return at.astimezone(dt.timezone.utc) if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def day_of(at: dt.datetime) -> dt.date:
    """The stored day (UTC) of a moment given in any zone."""
    return in_utc(at).date()


def field(name: str | Column) -> Column:
    """Column of a named field: a core column by name, anything else from ``attrs``."""
    if isinstance(name, Column):
        return name
    if name in CORE_COLUMNS or name.startswith("_"):
        return F.col(name)
    return F.col("attrs")[name]


def promote(df: DataFrame, names: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Copy hot fields out of the map into real columns, so filters on them reach Parquet."""
    from brooklog.functions.text import num

    cols = {n: F.col("attrs")[n] for n in names}
    cols.update({n: num(F.col("attrs")[n]) for n in numeric})
    return df.withColumns(cols)


def with_log_date(df: DataFrame) -> DataFrame:
    """Day of the row in UTC, in every session."""
    return df.withColumn("log_date", utc.date("timestamp"))


def with_row_id(df: DataFrame, source: str | Column = "_src") -> DataFrame:
    """Stable id ``{nanoseconds}-{source}-{sequence}``; the sequence keeps equal times apart."""
    src = F.col(source) if isinstance(source, str) else source
    nanos = (F.unix_micros("timestamp") * F.lit(1000)).cast("string")
    return df.withColumn("_id", F.concat_ws("-", nanos, src, F.col("_seq").cast("string")))
