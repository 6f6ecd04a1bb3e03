"""Reading raw lines, at rest and as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LINE_BYTES = 2 * 1024 * 1024

_ROW_IN_TASK = (1 << 33) - 1


def _file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B"))


def _clean(value: Column) -> Column:
    return F.regexp_replace(value, r"\r\z", "")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of UTF-8 text files in order: ``_src, block, line_no, line, source_mtime``.

    Lines end at LF; one trailing CR is dropped, a lone CR is content, empty lines are
    skipped.  ``block`` is the byte offset of the file split a line was read from and
    ``line_no`` its row number in the task that read it, so (block, line_no) is file order
    and no shuffle is needed to number the lines.  ``_src`` is the full path, as two files
    of one name must not be mixed up; shorten it with ``with_file_name`` at the end.
    """
    raw = spark.read.option("lineSep", "\n").text(list(paths) if not isinstance(paths, str) else paths)
    return raw.select(
        F.col("_metadata.file_path").alias("_src"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_TASK)).alias("line_no"),
        _clean(F.col("value")).alias("line"),
        F.col("_metadata.file_modification_time").alias("source_mtime"),
    ).filter(F.col("line") != "")


def with_file_name(df: DataFrame, prefix: str = "") -> DataFrame:
    """Replace a path in ``_src`` by the bare file name, with an optional prefix."""
    return df.withColumn("_src", F.concat(F.lit(prefix), _file_name(F.col("_src"))))


def validate_lines(df: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows whose line is short enough, and the rejected rest."""
    fits = F.octet_length("line") <= max_line_bytes
    return df.filter(fits), df.filter(~fits)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the row number inside the task; rows arrive in file order."""
    at = 0
    for batch in batches:
        numbers = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, "line_no"])


#: Bytes of new files that one batch of a stream takes in, unless it is bounded by files.
BATCH_BYTES = 1 << 30


def live_lines(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int = BATCH_BYTES) -> DataFrame:
    """Lines of files that appear in a directory, as a stream.

    Columns ``_src`` and ``part`` (the file), ``block, line_no`` (place in it), ``value`` and
    ``source_mtime``.  A stream cannot use the built-in row ids, so an Arrow pass counts the
    rows of each task.  A batch is bounded by files or else by bytes, so a full folder is worked
    off step by step.  Map ``_src`` to a logical source if its files belong together.
    """
    reader = spark.readStream.option("lineSep", "\n").schema("value string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    raw = reader.format("text").load(directory).select(
        F.col("_metadata.file_path").alias("_src"),
        F.col("_metadata.file_path").alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        _clean(F.col("value")).alias("value"),
        F.col("_metadata.file_modification_time").alias("source_mtime"),
    )
    schema = "_src string, part string, block long, value string, source_mtime timestamp, line_no long"
    return raw.mapInArrow(_numbered, schema).filter(F.col("value") != "")
