"""One search: page, total, columns and histogram from one filtered frame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from brooklog.functions import predicates as q
from brooklog.operators import histogram, paging, summary


@dataclass(frozen=True)
class SearchResult:
    """Lazy frames; each is computed when asked for, and reads only the columns it needs."""

    rows: DataFrame
    page: DataFrame
    totals: DataFrame
    columns: DataFrame
    distribution: DataFrame


def search(
    df: DataFrame,
    where: Column | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    sources: Sequence[str] | None = None,
    sort_by: str | Column = "timestamp",
    order: str = "desc",
    limit: int = 100,
    offset: int = 0,
    now: dt.datetime | None = None,
) -> SearchResult:
    """Filter by window, sources and predicate; without a window the last year is searched."""
    from_default, to_default = q.default_window(now or dt.datetime.now(dt.timezone.utc))
    start, end = start or from_default, end or to_default
    rows = df.filter(q.in_window(start, end)).filter(q.from_sources(sources))
    if where is not None:
        rows = rows.filter(where)
    if sort_by == "timestamp":
        dist = histogram.distribution(rows, start, end, sources)
    else:
        dist = histogram.distribution_auto(rows)
    return SearchResult(
        rows=rows,
        page=paging.page(rows, limit, offset, order, sort_by).drop("_seq"),
        totals=paging.page_summary(rows, limit, offset),
        columns=summary.available_columns(rows),
        distribution=dist,
    )
