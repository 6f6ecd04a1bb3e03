"""The log store: Parquet, one partition per day and batch, sorted by time inside each file.

Files and streams write the same layout and the same columns (``model.LOG_SCHEMA``, missing ones as
null).  A stream batch has its own number, so that a batch which runs again replaces what it wrote;
everything else is batch ``FILES``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklog import model
from brooklog.functions import utc
from brooklog.functions.text import num
from brooklog.operators.paging import sort_columns
from brooklog.session import BROADCAST_ROWS, settle

#: Batch of rows that do not come from a stream.
FILES = -1
STORED = T.StructType([*model.LOG_SCHEMA.fields, T.StructField("batch", T.LongType())])


def _laid_out(df: DataFrame) -> DataFrame:
    """Rows grouped by day with even task sizes: a hot day is split, small days are joined.

    The rebalance is done at run time from real sizes, so no day ends in one task and no
    task writes one small file per day.  Sorting lets readers skip row groups by time.
    """
    df = df if "log_date" in df.columns else model.with_log_date(df)
    return df.hint("rebalance", "log_date").sortWithinPartitions("log_date", "timestamp", "_seq")


def shaped(df: DataFrame) -> DataFrame:
    """The columns of the store; missing ones are null, others are left out."""
    df = df if "log_date" in df.columns else model.with_log_date(df)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in model.LOG_SCHEMA.fields))


def append(df: DataFrame, path: str) -> None:
    """Add rows to the store.

    Nothing is looked up: rows added twice are there twice.  A load that may run again should ``upsert`` instead, which
    leaves each ``_id`` once, also after any number of runs.
    """
    _laid_out(shaped(df)).withColumn("batch", F.lit(FILES).cast("long")).write.mode("append").partitionBy("log_date", "batch").parquet(path)


def replace_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write the rows of one stream batch; what an earlier try of the same batch wrote is replaced."""
    writer = shaped(df).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("log_date", "batch").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).drop("batch")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def scan(spark: SparkSession, path: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Rows of the days that touch [start, end]; other days are not read at all."""
    df = read_store(spark, path)
    if start is not None:
        df = df.filter(F.col("log_date") >= F.lit(model.day_of(start)))
    if end is not None:
        df = df.filter(F.col("log_date") <= F.lit(model.day_of(end)))
    return df


def upsert_rows(existing: DataFrame, new: DataFrame, order: str = "_seq") -> DataFrame:
    """Rows of ``new`` replace rows with the same ``_id``; among equals in ``new`` the last one wins.

    Copies of one id are reduced to one row per task before they are shuffled.
    """
    columns = existing.columns
    packed = F.struct(*columns)
    newest = new.groupBy("_id").agg(F.max_by(packed, F.col(order)).alias("r")).select("r.*")
    return existing.join(new.select("_id"), "_id", "left_anti").select(*columns).unionByName(newest)


def upsert(spark: SparkSession, path: str, new: DataFrame, order: str = "_seq") -> None:
    """Upsert into the store.  An id holds its time, so only the days of ``new`` are rewritten."""
    fresh = settle(shaped(new))
    days = [r[0] for r in fresh.select("log_date").distinct().collect()]  # one row per day
    old = _read(spark, path).filter(F.col("log_date").isin(days))
    parts = _parts(old)
    merged = settle(upsert_rows(old.drop("batch"), fresh, order))
    _overwrite_days(merged, path, parts)


def _parts(df: DataFrame) -> set[tuple[dt.date, int]]:
    """The (day, batch) folders that rows come from; one row per folder."""
    return {tuple(r) for r in df.select("log_date", "batch").distinct().collect()}


def _overwrite_days(df: DataFrame, path: str, parts: set[tuple[dt.date, int]]) -> None:
    """Write whole days as one batch, then drop the folders they were read from."""
    rows = settle(_laid_out(df).withColumn("batch", F.lit(FILES).cast("long")))
    written = _parts(rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch").parquet(path)
    _drop(df.sparkSession, path, [f"log_date={day.isoformat()}/batch={batch}" for day, batch in parts - written])


def _id_frame(spark: SparkSession, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Distinct ids; broadcast only when counted and found small."""
    if isinstance(ids, DataFrame):
        frame = ids.select(F.col(ids.columns[0]).alias("_id")).filter("_id <> ''").distinct()
        small = frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    else:
        wanted = sorted({i for i in ids if i})
        frame = spark.createDataFrame([(i,) for i in wanted], "_id string")
        small = len(wanted) <= BROADCAST_ROWS
    return F.broadcast(frame) if small else frame


def delete_ids(df: DataFrame, ids: Sequence[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and one row with the number of ids that really existed."""
    wanted = _id_frame(df.sparkSession, ids)
    kept = df.join(wanted, "_id", "left_anti")
    found = df.select("_id").join(wanted, "_id", "left_semi").distinct()
    return kept, found.agg(F.count(F.lit(1)).alias("n_deleted"))


def delete_from_store(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame) -> int:
    """Delete rows by id, rewriting only the days that hold them; returns how many went."""
    wanted = _id_frame(spark, ids)
    # An id opens with its time, so only the days of the ids are read.
    nanos = F.regexp_extract("_id", r"^(-?\d+)-", 1).try_cast("bigint")
    named = wanted.select(utc.date(F.timestamp_micros(utc.div(nanos, 1000))).alias("day")).filter("day is not null").distinct()
    stored = _read(spark, path).filter(F.col("log_date").isin([r[0] for r in named.collect()]))  # one row per day
    hit = settle(stored.select("_id", "log_date").join(wanted, "_id", "left_semi"))
    days = [r[0] for r in hit.select("log_date").distinct().collect()]  # one row per day
    if not days:
        return 0
    touched = stored.filter(F.col("log_date").isin(days))
    parts = _parts(touched)
    kept = settle(touched.drop("batch").join(hit.select("_id").distinct(), "_id", "left_anti"))
    _overwrite_days(kept, path, parts)
    return hit.select("_id").distinct().count()


def first_day_kept(max_age: dt.timedelta, now: dt.datetime) -> dt.date:
    """A day goes as a whole once its midnight is older than the limit."""
    cutoff = model.in_utc(now) - max_age
    midnight = cutoff.replace(hour=0, minute=0, second=0, microsecond=0)
    return cutoff.date() if cutoff == midnight else cutoff.date() + dt.timedelta(days=1)


def retain(df: DataFrame, max_age: dt.timedelta, now: dt.datetime) -> DataFrame:
    """Rows of days that are still young enough; a limit of zero or less keeps everything."""
    if max_age <= dt.timedelta(0):
        return df
    return df.filter(F.col("log_date").isNull() | (F.col("log_date") >= F.lit(first_day_kept(max_age, now))))


def _drop(spark: SparkSession, path: str, folders: Sequence[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def retain_store(spark: SparkSession, path: str, max_age: dt.timedelta, now: dt.datetime) -> int:
    """Remove whole day folders that are too old; returns how many days went."""
    if max_age <= dt.timedelta(0):
        return 0
    limit = first_day_kept(max_age, now)
    days = _read(spark, path).select("log_date").distinct().filter(F.col("log_date") < F.lit(limit))
    old = [r[0] for r in days.collect()]  # one row per day
    _drop(spark, path, [f"log_date={day.isoformat()}" for day in old])
    return len(old)


def export_frame(df: DataFrame, max_rows: int | None = None, sort_by: str = "timestamp", order: str = "desc") -> DataFrame:
    """The sorted result, all of it or its first rows, as JSON text; numbers are written as numbers."""
    top = df.orderBy(*sort_columns(sort_by, order))
    top = top if max_rows is None else top.limit(max_rows)
    core = [c for c in ("timestamp", "_id", "_raw", "_src", "error") if c in df.columns]
    entries = F.map_filter(
        F.create_map(*[x for c in core for x in (F.lit(c), _text_of(c))]), lambda k, v: v.isNotNull()
    )
    texts = F.map_concat(entries, F.map_filter("attrs", lambda k, v: ~k.isin(*core) & v.isNotNull()))
    typed = F.transform_values(
        texts,
        lambda k, v: F.coalesce(F.when(~k.startswith("_"), num(v)).cast("variant"), v.cast("variant")),
    )
    return top.select(F.to_json(typed).alias("value"))


def _text_of(name: str):
    if name == "timestamp":
        return utc.text("timestamp", 6)
    return F.col(name).cast("string")


def export_jsonl(
    df: DataFrame, path: str, max_rows: int | None = None, sort_by: str = "timestamp", order: str = "desc"
) -> None:
    """Write the export as JSON lines."""
    export_frame(df, max_rows, sort_by, order).write.mode("overwrite").text(path)


def store_info(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Overview of a store: per-day rows and bytes, totals, and source names."""
    stored = _read(spark, path)
    return info(stored.withColumns({"file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")}))


def info(stored: DataFrame) -> dict[str, DataFrame]:
    """The overview of rows that know their ``file`` and its ``size``.

    Rows are counted per file first, so a day's size is the sum over its own files.
    """
    files = stored.groupBy("log_date", "file", "size").agg(F.count(F.lit(1)).alias("rows"))
    days = files.groupBy("log_date").agg(F.sum("rows").alias("rows"), F.sum("size").alias("bytes"))
    totals = days.agg(
        F.count(F.lit(1)).alias("days"),
        F.min("log_date").alias("first_day"),
        F.max("log_date").alias("last_day"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
    )
    return {"days": days, "total": totals, "sources": stored.select("_src").distinct()}
