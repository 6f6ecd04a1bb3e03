"""Pages far down a result, by rank selection instead of a top-k of everything before them.

The order of a page is a list of views: numbers, or texts of which some bytes at a time are looked at as a number.  One
aggregation tells which views differ at all among the rows in question, and between which bounds; the others are passed
over.  Counting the rows in equal parts of the bounds of the first view tells in which part the first row of the page
lies; only its rows, whose own bounds come with the counts, stay in question.  A part that keeps most rows is cut at
quantiles instead.  Once all rows share one value the next view that differs is looked at, and once they are few they
are sorted.  Every pass is one aggregation, and each leaves about a thousandth of the rows unless values are tied; no
task ever holds the rows before the page.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklog import model
from brooklog.functions.text import num

#: Rows in question that are sorted without a further pass.
FEW = 100_000
#: Parts of one pass, and cut points where quantiles are taken.
PARTS, CUTS = 1024, 64
#: Bytes of a text that are looked at as one number.
BYTES = 6


class View(NamedTuple):
    """A number, or the bytes of a text, of every row; null stands at one end."""

    value: Column
    up: bool
    nulls_first: bool
    whole: bool = True
    text: bool = False


class Part(NamedTuple):
    """Neighbouring rows of the order: which, how many, and their bounds in the view (None: they have no value)."""

    which: Column
    n: int
    span: tuple | None


def _views(value: Column, kind: T.DataType, up: bool, nulls_first: bool) -> list[View]:
    if isinstance(kind, T.TimestampType):
        return [View(F.unix_micros(value), up, nulls_first)]
    if isinstance(kind, T.DateType):
        return [View(F.unix_date(value).cast("bigint"), up, nulls_first)]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # What is no number is greater than all numbers.
        odd = F.isnan(value)
        return [View(F.when(value.isNotNull(), odd.cast("bigint")), up, nulls_first), View(F.when(~odd, value.cast("double")), up, nulls_first, whole=False)]
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return [View((value * F.lit(10**kind.scale)).cast("bigint"), up, nulls_first)]
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return [View(value.cast("bigint"), up, nulls_first)]
    return [View(value.cast("string").cast("binary"), up, nulls_first, text=True)]


def order_views(df: DataFrame, sort_by: str | Column, order: str) -> list[View]:
    """The views of ``paging.sort_columns``, in the same order."""
    up = order == "asc"
    keys: list[tuple[Column, bool]] = []
    if isinstance(sort_by, str) and sort_by == "timestamp":
        keys = [(F.col(c), up) for c in ("timestamp", "_seq", "_id")]  # nulls come first going up, last going down
    else:
        value = model.field(sort_by)
        if isinstance(sort_by, str) and sort_by not in model.CORE_COLUMNS:
            is_text = F.when(value.isNotNull(), num(value).isNull())
            keys += [(is_text, False), (num(value), False), (F.when(is_text, value), False)]
        else:
            keys.append((value, False))
        keys += [(F.col("_seq"), False), (F.col("_id"), False)]
    return [view for key, nulls_first in keys for view in _views(key, df.select(key).schema[0].dataType, up, nulls_first)]


def _differing(rows: DataFrame, views: list[View]) -> tuple[int, list[View], tuple | None]:
    """How many rows there are, the views that differ among them, and the bounds of the first one.

    A text at the end, mostly the id of the rows, is asked only if nothing before it differs.
    """
    rest = views[-1:] if len(views) > 1 and views[-1].text else []
    views = views[: len(views) - len(rest)]
    measures = [m for v in views for m in (F.count(v.value), F.min(v.value), F.max(v.value))]
    total, *found = rows.agg(F.count(F.lit(1)), *measures).first()
    bounds = [tuple(found[i : i + 3]) for i in range(0, len(found), 3)]
    kept = [(v, lo, hi) for v, (n, lo, hi) in zip(views, bounds, strict=True) if n and (n < total or lo != hi)]
    if rest and not kept:
        return _differing(rows, rest)
    return total, [*(v for v, _, _ in kept), *rest], kept[0][1:] if kept else None


def _number(view: View, span: tuple) -> tuple[View, tuple]:
    """A text as a number, from the first byte on that not all share, and the bounds of that number."""
    lo, hi = (bytes(x) for x in span)
    at = len(os.path.commonprefix([lo, hi]))
    held = F.rpad(F.hex(F.substring(view.value, 1 + at, BYTES)), 2 * BYTES, "0")
    bounds = tuple(int.from_bytes(x[at : at + BYTES].ljust(BYTES, b"\0"), "big") for x in (lo, hi))
    return view._replace(value=F.conv(held, 16, 10).cast("bigint"), text=False), bounds


def _code(rows: DataFrame, view: View, span: tuple, by_rank: bool) -> Column:
    """A number that never falls as the view rises, and takes few values: the part of the bounds, or the place among quantiles."""
    value, (lo, hi) = view.value, span
    wide = float(hi - lo)
    if by_rank or not math.isfinite(wide) or wide / PARTS == 0:
        quantiles = [i / CUTS for i in range(CUTS + 1)]
        cuts = sorted(set(rows.agg(F.percentile_approx(value, quantiles, F.lit(10 * CUTS))).first()[0] or []))
        return reduce(Column.__add__, [(value >= c).cast("int") + (value > c).cast("int") for c in cuts])
    if view.whole and hi - lo < 2**52:
        above = (value - F.lit(lo).cast("bigint")).cast("double")
    else:
        above = value.cast("double") - F.lit(float(lo))
    return F.least(F.floor(above / F.lit(wide) * PARTS), F.lit(PARTS - 1)).cast("int")


def _parts(rows: DataFrame, view: View, span: tuple, by_rank: bool) -> list[Part]:
    """The rows cut along a view, in the order of the page."""
    value = view.value
    code = F.when(value.isNotNull(), _code(rows, view, span, by_rank)) if span[0] != span[1] else F.when(value.isNotNull(), 0)
    found = rows.groupBy(code.alias("code")).agg(F.count(F.lit(1)), F.min(value), F.max(value)).collect()  # PARTS rows at most, or two a cut point
    held = sorted((r for r in found if r[0] is not None), key=lambda r: r[0], reverse=not view.up)
    parts = [Part(value == lo if lo == hi else value.between(lo, hi), n, (lo, hi)) for _, n, lo, hi in held]
    none = [Part(value.isNull(), r[1], None) for r in found if r[0] is None]
    return none + parts if view.nulls_first else parts + none


def _pieces(
    df: DataFrame, views: list[View], offset: int, limit: int, few: int, known: int | None = None, span: tuple | None = None, by_rank: bool = False, inside_of: Column | None = None
) -> Iterator[tuple[Column, int]]:
    """(which rows, rows to pass over): together, in this order, they hold the page and all that follows up to its end.

    ``inside_of`` are the rows in question (all by default), ``span`` the bounds of the first view among them if they are known.
    """
    inside_of = F.lit(True) if inside_of is None else inside_of
    rows, total = df.filter(inside_of), known
    if span is None and (known is None or known > few):
        total, views, span = _differing(rows, views)
    if offset >= total:
        return
    if total <= few or not views:
        yield inside_of, offset
        return
    text = views[0].text
    view, span = _number(views[0], span) if text else (views[0], span)
    parts = _parts(rows, view, span, by_rank)
    ends = list(accumulate(p.n for p in parts))
    at = next(i for i, end in enumerate(ends) if end > offset)
    which, n, inside = parts[at]
    before = ends[at] - n
    taken = min(limit, ends[at] - offset)
    if n == total and (text or by_rank):
        yield inside_of, offset  # texts that differ in nothing but zero bytes at their end
        return
    # Bounds of a text say nothing about its next bytes; all rows of one value, or without one, go on to the next view.
    done = inside is None or inside[0] == inside[1]
    go_on = None if text or done else inside
    yield from _pieces(df, views, offset - before, taken, few, n, go_on, not text and not done and 2 * n > total, inside_of & which)
    if taken < limit and at + 1 < len(parts):
        # What follows is taken from its beginning, which is no deep page.
        later = [view.value.isNull()] if parts[-1].span is None else []
        later += [view.value > inside[1] if view.up else view.value < inside[0]] if inside else [view.value.isNotNull()]
        yield inside_of & reduce(Column.__or__, later), 0


def page_deep(df: DataFrame, limit: int, offset: int, order: str = "desc", sort_by: str | Column = "timestamp", few: int = FEW) -> DataFrame:
    """The same page as ``paging.page``; runs its counting passes at once.

    Each pass over the rows in question leaves about a thousandth of them, or those of one value.  Pages within the first ``few`` rows are
    sorted right away.
    """
    from brooklog.operators.paging import check_page, sort_columns

    check_page(limit, offset, order)
    by = sort_columns(sort_by, order)
    if offset + limit <= few:
        return (df.orderBy(*by).offset(offset) if offset else df.orderBy(*by)).limit(limit)
    pieces = list(_pieces(df, order_views(df, sort_by, order), offset, limit, few))
    if not pieces:
        return df.limit(0)
    # One scan: only rows of the first piece, which are few, come before the page.
    ordered = df.filter(reduce(Column.__or__, [which for which, _ in pieces])).orderBy(*by)
    skip = pieces[0][1]
    return (ordered.offset(skip) if skip else ordered).limit(limit)
