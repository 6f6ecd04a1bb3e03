"""Pages of a result, in a total order."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions.text import num
from brooklog.operators.deep_paging import page_deep

MAX_PAGE = 1000
#: Offsets beyond it are found by rank selection, see ``deep_paging``.
DEEP_OFFSET = 100_000


@dataclass(frozen=True)
class LastKey:
    """Sort key of the last row of a page."""

    timestamp: dt.datetime
    seq: int
    id: str


def check_page(limit: int, offset: int, order: str) -> None:
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def sort_columns(sort_by: str | Column = "timestamp", order: str = "desc") -> list[Column]:
    """The order of a page.

    By time: timestamp, ``_seq``, ``_id``, all in one direction.  By another field: rows
    without it come last in both directions; numbers are compared as numbers and stand
    apart from text, and ties go by ``_seq`` and ``_id``.
    """
    up = order == "asc"

    def last(c: Column) -> Column:
        return c.asc_nulls_last() if up else c.desc_nulls_last()

    if isinstance(sort_by, str) and sort_by == "timestamp":
        keys = [F.col("timestamp"), F.col("_seq"), F.col("_id")]
        return [k.asc() if up else k.desc() for k in keys]
    value = model.field(sort_by)
    ties = [last(F.col("_seq")), last(F.col("_id"))]
    if isinstance(sort_by, str) and sort_by not in model.CORE_COLUMNS:
        is_text = F.when(value.isNotNull(), num(value).isNull())
        return [last(is_text), last(num(value)), last(F.when(is_text, value)), *ties]
    return [last(value), *ties]


def page(
    df: DataFrame,
    limit: int,
    offset: int = 0,
    order: str = "desc",
    sort_by: str | Column = "timestamp",
) -> DataFrame:
    """One page.  Planned as a bounded top-k (offset + limit rows per task), not as a full sort.

    A page that begins beyond ``DEEP_OFFSET`` is found by counting passes instead, which run at once.
    """
    check_page(limit, offset, order)
    if offset > DEEP_OFFSET:
        return page_deep(df, limit, offset, order, sort_by)
    ordered = df.orderBy(*sort_columns(sort_by, order))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_summary(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Total, effective offset (0 when past the end) and row count of the page, in one row."""
    total = F.col("total")
    past_end = total <= F.lit(offset)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        total,
        F.when(past_end, 0).otherwise(offset).cast("long").alias("offset"),
        F.when(past_end, 0).otherwise(F.least(total - offset, F.lit(limit))).cast("long").alias("count"),
    )


def page_after(df: DataFrame, last: LastKey, limit: int, order: str = "desc") -> DataFrame:
    """The page that follows a known last row; no offset to skip over.

    The plain bound on ``timestamp`` is stated besides the exact key test because only
    that one can reach Parquet statistics.
    """
    check_page(limit, 0, order)
    key = F.struct(F.col("timestamp"), F.col("_seq"), F.col("_id"))
    mark = F.struct(model.moment(last.timestamp), F.lit(last.seq).cast("long"), F.lit(last.id))
    if order == "desc":
        rest = df.filter((F.col("timestamp") <= model.moment(last.timestamp)) & (key < mark))
    else:
        rest = df.filter((F.col("timestamp") >= model.moment(last.timestamp)) & (key > mark))
    return page(rest, limit, order=order)


def latest(df: DataFrame, n: int = MAX_PAGE) -> DataFrame:
    """The newest ``n`` rows, newest first."""
    return df.orderBy(*sort_columns()).limit(n)


def dropped(df: DataFrame, n: int = MAX_PAGE) -> DataFrame:
    """How many rows fall outside the newest ``n``."""
    return df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).cast("long").alias("dropped"))
