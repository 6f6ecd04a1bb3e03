"""Running values along the lines of a source, spread over its blocks.

A window over a whole source would put it into one task.  Here the window runs inside
each (source, block); one summary row per block is then scanned along the source, and
its running value is joined back.  Both sides of that join are partitioned by
(source, block), so full rows are shuffled once; the summary comes from a scan of the few
columns it needs, aggregated per task before its own shuffle.  Rows without a source are a
source of their own, rows without a block its first block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("_src", "block")

#: What a missing source or block is called while rows are joined to their block.
NO_SOURCE, NO_BLOCK = "\x00", -(1 << 63)


def settle_keys(df: DataFrame) -> DataFrame:
    """Give rows without source or block a value to join on, so that none is lost."""
    return df.withColumns({"_src": F.coalesce("_src", F.lit(NO_SOURCE)), "block": F.coalesce("block", F.lit(NO_BLOCK))})


def restore_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"_src": F.nullif("_src", F.lit(NO_SOURCE)), "block": F.nullif("block", F.lit(NO_BLOCK))})


def in_block() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("line_no")


def up_to_here() -> WindowSpec:
    return in_block().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_here() -> WindowSpec:
    return in_block().rowsBetween(Window.unboundedPreceding, -1)


def whole_block() -> WindowSpec:
    return Window.partitionBy(*KEY)


def earlier_blocks() -> WindowSpec:
    """Over summary rows: one row per block, so a source of 100 TB has about a million."""
    return Window.partitionBy("_src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def join_blocks(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Join one summary row per block back to its rows.

    A merge join keeps the rows where the window put them: they are neither shuffled again
    nor ever taken for the side to broadcast.
    """
    return rows.join(summary.hint("merge"), list(KEY))


def with_seq(df: DataFrame, out: str = "_seq") -> DataFrame:
    """Number the rows of each source 1, 2, 3, … in order."""
    df = settle_keys(df)
    numbered = df.withColumn("_at", F.row_number().over(in_block()))
    sizes = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*KEY, F.coalesce(F.sum("_n").over(earlier_blocks()), F.lit(0)).alias("_before"))
    joined = join_blocks(numbered, offsets)
    return restore_keys(joined.withColumn(out, (F.col("_before") + F.col("_at")).cast("long")).drop("_at", "_before"))


def carry(df: DataFrame, values: dict[str, Column], before: dict[str, Column] | None = None) -> DataFrame:
    """Per output name, the last non-null value of an expression up to and including each row.

    Values in ``before`` leave the row itself out.
    """
    before = before or {}
    everything = {**values, **before}
    staged = settle_keys(df).withColumns({f"_v_{out}": value for out, value in everything.items()})

    def held(out: str) -> Column:
        return F.last(F.col(f"_v_{out}"), ignorenulls=True).over(before_here() if out in before else up_to_here())

    rows = staged.withColumns({out: held(out) for out in everything})
    summary = staged.groupBy(*KEY).agg(
        *[
            F.max_by(F.col(f"_v_{out}"), F.when(F.col(f"_v_{out}").isNotNull(), F.col("line_no"))).alias(f"_in_{out}")
            for out in everything
        ]
    )
    entering = summary.select(
        *KEY, *[F.last(F.col(f"_in_{o}"), ignorenulls=True).over(earlier_blocks()).alias(f"_in_{o}") for o in everything]
    )
    joined = join_blocks(rows, entering)
    joined = joined.withColumns({out: F.coalesce(F.col(out), F.col(f"_in_{out}")) for out in everything})
    return restore_keys(joined.drop(*[f"_in_{out}" for out in everything], *[f"_v_{out}" for out in everything]))
