"""Folding physical lines into records (stack traces, indented blocks)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.functions.javaregex import checked
from brooklog.operators.ordering import (
    KEY, earlier_blocks, in_block, join_blocks, restore_keys, settle_keys, up_to_here, whole_block,
)

MAX_LINES = 100
MAX_BYTES = 1 << 20

# What continues a stack trace, and the header shapes tried on a sample.
TRACE_CONTINUATION = (
    r"(?i)^(?:[\t ]|at |Caused by:|\.\.\. \d+ more|"
    r"(?:[a-zA-Z_$][\w$]*\.)+[A-Za-z_$][\w$]*(?:Exception|Error|Throwable)\b)"
)
SYSLOG_HEADER = r"^[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}"
ISO_HEADER = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"

CANDIDATES = (("syslog", "header", SYSLOG_HEADER), ("iso8601", "header", ISO_HEADER), ("indent", "indent", None))


def is_header(line: Column, mode: str, header: str | None = None) -> Column:
    """Does the line open a record?"""
    if mode == "header":
        if not header:
            raise ValueError("header mode needs a header pattern")
        return line.rlike(checked(header, "header pattern"))
    if mode == "indent":
        return ~line.rlike(r"^[ \t]")
    raise ValueError(f"unknown fold mode {mode!r}")


def is_trace_continuation(line: Column) -> Column:
    return line.rlike(TRACE_CONTINUATION)


def fold(
    df: DataFrame,
    mode: str = "header",
    header: str | None = None,
    max_lines: int = MAX_LINES,
    max_bytes: int = MAX_BYTES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Join continuation lines to their record with single spaces.

    In: ``_src, block, line_no, line`` (+ ``keep``).  Out: ``_src, block, line_no, _raw,
    n_lines, oversize`` with the position of the record's first line.  A record takes at
    most ``max_lines`` continuation lines, then a new one starts, so no group is ever
    larger than that even in a source without any header.  Lines before the first header
    form a record of their own.
    """
    if mode == "off":
        return df.withColumns(
            {"_raw": F.col("line"), "n_lines": F.lit(1), "oversize": F.octet_length("line") > max_bytes}
        ).select("_src", "block", "line_no", "_raw", "n_lines", "oversize", *keep)

    lines = settle_keys(df.select("_src", "block", "line_no", "line", *keep))
    lines = lines.withColumn("_head", is_header(F.col("line"), mode, header)).withColumn(
        "_at", F.row_number().over(in_block())
    )
    # Line number of the last header inside the block, and the size of the block.
    lines = lines.withColumns(
        {
            "_head_at": F.max(F.when(F.col("_head"), F.col("_at"))).over(up_to_here()),
            "_size": F.count(F.lit(1)).over(whole_block()),
        }
    )
    blocks = lines.filter(F.col("_at") == F.col("_size")).select(*KEY, "_size", "_head_at")
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_size").over(earlier_blocks()), F.lit(0)))
    blocks = blocks.select(
        *KEY,
        "_before",
        F.max(F.col("_before") + F.col("_head_at")).over(earlier_blocks()).alias("_open_at"),
    )
    placed = join_blocks(lines, blocks)
    number = F.col("_before") + F.col("_at")
    head = F.coalesce(F.col("_before") + F.col("_head_at"), F.col("_open_at"), F.lit(1))
    step = F.lit(max_lines + 1)
    placed = placed.withColumn("_start", number - F.pmod(number - head, step))
    # Rows lie by block already, so what a record has in one block is put together without moving any line.
    pieces = placed.groupBy(*KEY, "_start").agg(
        F.array_sort(F.collect_list(F.struct("_at", "line"))).alias("_lines"),
        F.min("_at").alias("_from"),
        F.max("_at").alias("_upto"),
        F.max("_size").alias("_size"),
        F.max("_before").alias("_before"),
        F.min_by(F.struct("block", "line_no", *keep), "_at").alias("_first"),
    )
    pieces = pieces.select(
        "_src",
        "_start",
        (F.col("_before") + F.col("_from")).alias("_number"),
        F.array_join(F.transform("_lines", lambda x: x["line"]), " ").alias("_raw"),
        F.size("_lines").alias("n_lines"),
        "_first",
        ((F.col("_upto") == F.col("_size")) | (F.col("_start") <= F.col("_before"))).alias("_open"),
    )
    # Only the first and last piece of a block may go on in another; these few are stitched along the source.
    stitched = pieces.filter("_open").groupBy("_src", "_start").agg(
        F.array_sort(F.collect_list(F.struct("_number", "_raw"))).alias("_parts"),
        F.sum("n_lines").cast("int").alias("n_lines"),
        F.min_by("_first", "_number").alias("_first"),
    )
    stitched = stitched.withColumn("_raw", F.array_join(F.transform("_parts", lambda x: x["_raw"]), " "))
    columns = ["_src", "_raw", "n_lines", "_first"]
    records = pieces.filter(~F.col("_open")).select(*columns).unionByName(stitched.select(*columns))
    folded = records.select(
        "_src",
        "_first.block",
        "_first.line_no",
        "_raw",
        "n_lines",
        (F.octet_length("_raw") > max_bytes).alias("oversize"),
        *[F.col(f"_first.{c}").alias(c) for c in keep],
    )
    return restore_keys(folded)


def detect_fold(df: DataFrame, library: Sequence[str] = ()) -> DataFrame:
    """Best folding style of each source: ``_src, name, mode, header, score``; null when none fits.

    All candidates are counted side by side in one aggregation; nothing is folded.  A
    candidate's records are the lines that open one (and the first line); a record that
    looks like stack-trace text is an orphan and costs eight joined lines.  ``library``
    holds regular expressions of known formats: if one of them fits most record heads, the
    candidate gains two.
    """
    line, at = F.col("line"), F.struct("block", "line_no")
    trace = is_trace_continuation(line)
    known = F.lit(False)
    for pattern in library:
        known = known | line.rlike(pattern)
    aggs = [
        F.count(F.lit(1)).alias("lines"),
        F.count_if(trace & ~line.rlike(r"^[ \t]")).alias("bare_trace"),
        F.min_by(trace, at).alias("first_trace"),
        F.min_by(known, at).alias("first_known"),
    ]
    for name, mode, header in CANDIDATES:
        head = is_header(line, mode, header)
        aggs += [
            F.count_if(head).alias(f"{name}_heads"),
            F.count_if(head & trace).alias(f"{name}_orphans"),
            F.count_if(head & known).alias(f"{name}_known"),
            F.min_by(head, at).alias(f"{name}_first"),
        ]
    stats = df.groupBy("_src").agg(*aggs)

    options = []
    for rank, (name, mode, header) in enumerate(CANDIDATES):
        lead = F.when(F.col(f"{name}_first"), 0).otherwise(1)
        records = F.col(f"{name}_heads") + lead
        orphans = F.col(f"{name}_orphans") + F.when(F.col("first_trace"), lead).otherwise(0)
        fits = (F.col(f"{name}_known") + F.when(F.col("first_known"), lead).otherwise(0)) * 2 > records
        score = F.col("lines") - records - 8 * orphans + F.when(fits, 2).otherwise(0)
        usable = (F.col("lines") >= 3) & (records >= 2) & (records < F.col("lines")) & (score > 0)
        if mode == "indent":
            usable &= F.col("bare_trace") == 0
        options.append(
            F.when(
                usable,
                F.struct(
                    score.cast("long").alias("score"),
                    F.lit(-rank).alias("order"),
                    F.lit(name).alias("name"),
                    F.lit(mode).alias("mode"),
                    F.lit(header).cast("string").alias("header"),
                ),
            )
        )
    best = F.array_max(F.array_compact(F.array(*options)))
    return stats.select("_src", best.alias("b")).select("_src", "b.name", "b.mode", "b.header", "b.score")
