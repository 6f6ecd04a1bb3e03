"""Shaping a result for reading: columns and highlights."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions.javaregex import usable


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen fields, always led by ``timestamp``."""
    names = ["timestamp", *[c for c in dict.fromkeys(columns) if c != "timestamp"]]
    return df.select(*[(F.col(c) if c in df.columns else model.field(c)).alias(c) for c in names])


@dataclass(frozen=True)
class Mark:
    """Something to highlight."""

    value: str
    field: str | None = None
    excluded: bool = False
    is_regex: bool = False


def _spans(text: Column, pattern: str) -> Column:
    """Character spans [from, to) of all matches, left to right."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc: Column, i: Column) -> Column:
        a = acc["at"] + F.length(F.element_at(gaps, i))
        b = a + F.length(F.element_at(hits, i))
        span = F.struct(a.alias("a"), b.alias("b"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    index = F.when(F.size(hits) > 0, F.sequence(F.lit(1), F.size(hits))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(index, start, add, lambda acc: acc["out"])


def _merge(spans: Column) -> Column:
    """Join overlapping and touching spans."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        touching = (F.size(acc) > 0) & (s["a"] <= F.get(acc, F.size(acc) - 1)["b"])
        return F.when(touching, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(s))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<a:int,b:int>>"), step)


def highlight(
    df: DataFrame, marks: Sequence[Mark], pre: str = "<b>", post: str = "</b>", column: str = "_raw"
) -> DataFrame:
    """Add ``highlighted``: the column with every marked span wrapped; meant for a page of results."""
    patterns = []
    for mark in marks:
        if mark.excluded or (mark.field and mark.field != column) or not mark.value:
            continue
        pattern = usable(mark.value) if mark.is_regex else re.escape(mark.value)
        if pattern is not None:
            patterns.append("(?iu)" + pattern)
    text = model.field(column)
    if not patterns:
        return df.withColumn("highlighted", text)
    merged = _merge(F.concat(*[_spans(text, p) for p in patterns]))

    def paint(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["a"] - acc["at"])
        inside = F.substring(text, s["a"] + 1, s["b"] - s["a"])
        return F.struct(
            s["b"].alias("at"), F.concat(acc["out"], before, F.lit(pre), inside, F.lit(post)).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(
        merged, start, paint, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
    return df.withColumn("highlighted", F.when(text.isNotNull(), whole))
