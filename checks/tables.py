"""The driver's tables seen as log rows, raw lines and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions import utc


#: The session zone of the queries; no row depends on it, and a test sets others.
ZONE = "UTC"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", ZONE)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _attrs(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log rows: the type is the source, the id the sequence."""
    ts = utc.from_wall("ts")
    df = table(spark, sf, "events").select(
        ts.alias("timestamp"),
        utc.date(ts).alias("log_date"),
        F.concat_ws(" ", utc.text(ts, between=" ", end=""), "event_type", F.concat(F.lit("user"), "user_id")).alias("_raw"),
        F.col("event_type").alias("_src"),
        F.col("event_id").alias("_seq"),
        F.lit(None).cast("string").alias("error"),
        _attrs(user_id=F.col("user_id"), value=F.col("value"), k=F.get_json_object("props", "$.k")).alias("attrs"),
    )
    return model.with_row_id(df)


def document_log(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as log rows, one a minute."""
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    df = table(spark, sf, "documents").select(
        ts.alias("timestamp"),
        utc.date(ts).alias("log_date"),
        F.col("text").alias("_raw"),
        F.col("source").alias("_src"),
        F.col("doc_id").alias("_seq"),
        F.lit(None).cast("string").alias("error"),
        _attrs(lang=F.col("lang"), n_chars=F.col("n_chars")).alias("attrs"),
    )
    return model.with_row_id(df)


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Physical lines of the documents, in document order inside each source.

    A document is one block.  A line that starts with a small letter is indented, so that
    both folding modes have something to fold.
    """
    pieces = F.posexplode(F.split("text", "\n", -1)).alias("pos", "piece")
    lines = table(spark, sf, "documents").select("source", "doc_id", pieces).filter(F.col("piece") != "")
    return lines.select(
        F.col("source").alias("_src"),
        F.col("doc_id").alias("block"),
        F.col("pos").cast("long").alias("line_no"),
        F.when(F.col("piece").rlike("^[a-z]"), F.concat(F.lit(" "), "piece")).otherwise(F.col("piece")).alias("line"),
    )


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events printed as log lines in three formats, one of which no pattern knows."""
    ts = utc.text(utc.from_wall("ts"), between=" ", end="")
    plain = F.concat_ws(" ", ts, F.upper("event_type"), F.concat(F.lit("user="), "user_id"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    pairs = F.concat(F.lit("ts="), ts, F.lit(" type="), "event_type", F.lit(" user="), "user_id", F.lit(' msg="seen"'))
    other = F.concat(F.lit("?? "), "event_type")
    pick = F.col("event_id") % 5
    return table(spark, sf, "events").select(
        F.col("event_type").alias("_src"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("block"),
        F.col("event_id").alias("line_no"),
        F.when(pick < 3, plain).when(pick == 3, pairs).otherwise(other).alias("line"),
    )


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    return event_lines(spark, sf).withColumnRenamed("line", "_raw")


def timed_events(spark: SparkSession, sf: str, **fields: Column) -> DataFrame:
    """Events as parsed records whose time fields are made from ``ts`` (a timestamp column)."""
    df = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return df.select(
        F.col("event_type").alias("_src"),
        F.floor(F.col("event_id") / 700).cast("long").alias("block"),
        F.col("event_id").alias("line_no"),
        F.map_filter(_attrs(**fields), lambda k, v: v.isNotNull()).alias("attrs"),
        F.lit(True).alias("matched"),
        F.lit("").alias("_raw"),
    )
