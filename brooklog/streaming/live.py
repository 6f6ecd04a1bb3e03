"""Continuous ingest with Structured Streaming.

Folding keeps an open record per source in keyed state.  Closed records then go, batch by
batch, through the same extraction and time resolution as files do; what a source carries
from batch to batch (its time settings, last time and last sequence number) lies in a small
table with one row per source.  Each batch writes its rows and its carry table under its
own batch number, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from brooklog import model
from brooklog.functions import utc
from brooklog.model import moment
from brooklog.operators import ordering, timeres
from brooklog.operators.fold import is_header
from brooklog.operators.ordering import KEY, NO_SOURCE, earlier_blocks, join_blocks, settle_keys, up_to_here
from brooklog.plans.ingest import IngestOptions, finish, parse
from brooklog.session import settle
from brooklog.sources import store

FLUSH_INTERVAL = "250 milliseconds"
IDLE_TIMEOUT = "60 minutes"

_RECORDS = "_src string, block long, line_no long, line string, source_mtime timestamp"
_STATE = "open string, opened_at long, lines int, next_no long, mtime timestamp"

SETTINGS = ("anchor", "rollover", "dated", "synthetic", "source_field")
CARRY = (
    "_src string, seq long, last_us long, last_zone string, seen boolean, anchor timestamp, "
    "rollover boolean, dated boolean, synthetic boolean, source_field string"
)


@dataclass(frozen=True)
class LiveOptions:
    """Ingest options plus the streaming ones.  ``flush_column`` marks rows that close their source's record."""

    ingest: IngestOptions = field(default_factory=IngestOptions)
    idle_timeout: str = IDLE_TIMEOUT
    flush_interval: str = FLUSH_INTERVAL


def _millis(text: str) -> int:
    amount, unit = text.split()
    scale = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}
    return int(float(amount) * scale[unit.rstrip("s")])


def fold_stream(lines: DataFrame, opts: LiveOptions) -> DataFrame:
    """Closed records of a stream of ``_src, block, line_no, value`` (+ ``source_mtime``, ``flush``).

    A record is closed by the next header, by the line cap, by a row with ``flush`` set
    (end of stream, stop, rotation) or when its source has been idle for the timeout.
    The lines of a source come in order of file time, file, block and line number.
    """
    ing = opts.ingest
    idle = _millis(opts.idle_timeout)
    shaped = lines.select(
        "_src",
        "block",
        "line_no",
        "value",
        (F.col("source_mtime") if "source_mtime" in lines.columns else F.lit(None).cast("timestamp")).alias("mtime"),
        (F.col("flush") if "flush" in lines.columns else F.lit(False)).alias("flush"),
        (F.col("part") if "part" in lines.columns else F.lit("")).alias("part"),
        (F.lit(True) if ing.fold_mode == "off" else is_header(F.col("value"), ing.fold_mode, ing.fold_header)).alias("head"),
    )
    single, cap = ing.fold_mode == "off", ing.max_lines

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, opened_at, n, next_no, mtime = state.get if state.exists else (None, 0, 0, 0, None)
        out: list[tuple] = []

        def close() -> None:
            nonlocal text, n
            if text is not None:
                out.append((key[0], 0, opened_at, text, mtime))
            text, n = None, 0

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["mtime", "part", "block", "line_no"])
            for value, head, flush, m in zip(rows["value"], rows["head"], rows["flush"], rows["mtime"]):
                if value is not None:
                    if text is None or head or n > cap:
                        close()
                        text, opened_at, n, mtime = value, next_no, 1, m
                    else:
                        text, n = f"{text} {value}", n + 1
                    next_no += 1
                if flush or single:
                    close()
            state.update((text, opened_at, n, next_no, None if mtime is None or pd.isna(mtime) else mtime))
            state.setTimeoutDuration(idle)
        if out:
            yield pd.DataFrame(out, columns=["_src", "block", "line_no", "line", "source_mtime"]).astype(
                {"source_mtime": "datetime64[ns]"}
            )

    return shaped.groupBy("_src").applyInPandasWithState(
        step, _RECORDS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def _carried(spark: SparkSession, state_path: str, before: int) -> DataFrame:
    """What every source carried out of the batches before this one: its newest row."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state_path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], CARRY)
    past = spark.read.schema(CARRY + ", batch long").parquet(state_path).filter(F.col("batch") < before)
    newest = past.groupBy("_src").agg(F.max_by(F.struct("*"), F.col("batch")).alias("r"))
    return newest.select("r.*").drop("batch")


def _forget(spark: SparkSession, state_path: str, number: int) -> None:
    """Drop carry tables that no batch can read again: all but this batch's and the one before it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state_path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in system.listStatus(root) if f.getPath().getName().startswith("batch=")]
    held = sorted(folders, key=lambda f: int(f.getName().split("=")[1]))
    for folder in [f for f in held if int(f.getName().split("=")[1]) < number][:-1]:
        system.delete(folder, True)


def _moment_of(spark: SparkSession, path: str, number: int, now: Callable[[], dt.datetime]) -> dt.datetime:
    """The moment of a batch, settled by its first try, so that a further one gives the same rows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    prefix = f"{number}-"
    system.mkdirs(root)
    held = {f.getPath().getName() for f in system.listStatus(root)}
    for old in [h for h in held if int(h.split("-")[0]) < number - 1]:
        system.delete(jvm.org.apache.hadoop.fs.Path(root, old), False)
    found = [h for h in held if h.startswith(prefix)]
    if not found:
        # The name says it all; an empty file is there or not, never half written.
        found = [f"{prefix}{model.micros(now())}"]
        system.create(jvm.org.apache.hadoop.fs.Path(root, found[0])).close()
    us = int(min(found).split("-", 1)[1])
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)


def resolve_batch(records: DataFrame, carried: DataFrame, opts: IngestOptions, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Resolve and number the records of one batch given what their sources carried in.

    Returns the rows with ``timestamp``, ``ts_confidence`` and ``_seq``, and the new carry
    table.  A source keeps the settings taken from its first batch.
    """
    new = records.join(carried.select("_src"), "_src", "left_anti")
    if opts.time is not None:
        cfg = opts.time
        anchor = F.col(cfg.anchor_column) if cfg.anchor_column else moment(cfg.anchor)
        fresh = new.groupBy("_src").agg(
            F.max(anchor).alias("anchor"),
            F.lit(cfg.rollover).alias("rollover"),
            F.lit(cfg.dated and not cfg.rollover).alias("dated"),
            F.lit(cfg.synthetic).alias("synthetic"),
            F.lit(cfg.source_field or None).cast("string").alias("source_field"),
        )
    else:
        profile = timeres.profile_time(new, F.col("source_mtime"), now)
        fresh = profile.select(
            "_src",
            "anchor",
            "rollover",
            "dated",
            (F.col("status") == "missing").alias("synthetic"),
            "source_field",
        )
    start = fresh.select(
        "_src",
        *SETTINGS,
        F.lit(0).cast("long").alias("before"),
        F.lit(None).cast("long").alias("last_us"),
        F.lit(None).cast("string").alias("last_zone"),
        F.lit(False).alias("seen"),
    )
    present = records.select("_src").distinct()
    known = carried.join(present, "_src", "left_semi").withColumnRenamed("seq", "before").select(*start.columns)
    settings = settle(known.unionByName(start))  # one row per source of the batch, read several times below
    # The last time of a source enters its batch as one line in front of the first.
    lead = settings.filter("seen and not synthetic").select(
        "_src",
        F.lit(-1).cast("long").alias("block"),
        F.lit(0).cast("long").alias("line_no"),
        F.create_map(F.lit(LEAD_FIELD), F.concat_ws("|", F.col("last_us").cast("string"), "last_zone")).alias("attrs"),
        F.lit(True).alias("matched"),
    )
    base = records.select("_src", "block", "line_no", "attrs", "matched").unionByName(lead)
    profile = settings.select(
        "_src",
        "anchor",
        "rollover",
        "dated",
        F.when(F.col("synthetic"), "missing").otherwise("inferred").alias("status"),
        "source_field",
    )
    cfg = opts.time or timeres.TimeConfig(anchor=now)
    timed = timeres.resolve(base, cfg, profile, LEAD_FIELD, timeres.modes_of(profile))
    timed = timed.filter(F.col("block") >= 0).select("_src", "block", "line_no", "timestamp", "ts_confidence", "ts_zone")
    rows = ordering.with_seq(records.join(timed, ["_src", "block", "line_no"]))
    rows = rows.join(settings.select("_src", "before", "synthetic", F.col("anchor").alias("_base")), "_src")
    rows = rows.withColumn("_seq", F.col("_seq") + F.col("before"))
    tick = F.timestamp_micros(F.unix_micros("_base") + F.col("_seq"))
    rows = rows.withColumn("timestamp", F.when(F.col("synthetic"), tick).otherwise(F.col("timestamp")))
    rows = settle(rows)
    last = rows.groupBy("_src").agg(
        F.max("_seq").alias("seq"),
        F.max_by(F.unix_micros("timestamp"), "_seq").alias("now_us"),
        F.max_by("ts_zone", "_seq").alias("now_zone"),
        F.bool_or("matched").alias("now_seen"),
    )
    out = last.join(settings, "_src").select(
        "_src",
        "seq",
        F.when(F.col("now_seen") | F.col("seen"), F.col("now_us")).alias("last_us"),
        F.col("now_zone").alias("last_zone"),
        (F.col("now_seen") | F.col("seen")).alias("seen"),
        *SETTINGS,
    )
    return rows.drop("before", "synthetic", "_base", "ts_zone"), out


LEAD_FIELD = "_last_us"


def live_ingest(
    lines: DataFrame,
    opts: LiveOptions,
    path: str,
    checkpoint: str,
    publish: Callable[[DataFrame, int], None] | None = None,
    once: bool = False,
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
) -> StreamingQuery:
    """Fold, extract, resolve, store, then publish each batch.

    ``publish(rows, batch)`` gets rows that are already stored, with ``_id`` and without
    ``_seq``.  ``path`` and ``checkpoint`` must be on shared storage.  ``once`` processes
    what is there and stops.
    """
    state_path = f"{checkpoint}/carry"
    ing = replace(opts.ingest, fold_mode="off")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The one action on the batch itself: the state of every source moves on exactly once.
        records = settle(parse(batch, ing))
        if records.isEmpty():
            return
        past = _carried(spark, state_path, number)
        rows, carry = resolve_batch(records, past, ing, _moment_of(spark, f"{checkpoint}/moments", number, now))
        stored = finish(rows, ing)
        # Each carry table holds every source, so that older ones can go once this one is written.
        whole = carry.unionByName(past.join(carry.select("_src"), "_src", "left_anti"))
        carry = settle(whole).withColumn("batch", F.lit(number).cast("long"))
        store.replace_batch(stored, path, number)
        carry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state_path)
        _forget(spark, state_path, number)
        if publish is not None:
            publish(stored.drop("_seq"), number)

    writer = fold_stream(lines, opts).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/query")
    if not once:
        return writer.trigger(processingTime=opts.flush_interval).start()
    # Batches without data exist for timeouts only and would never end here.
    conf, flag = lines.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    usual = conf.get(flag)
    conf.set(flag, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(flag, usual)


def _counted_up_to(counts: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with ``upto``: the sum of ``n`` of the rows of ``counts`` before each point.

    Both have ``_src, block, line_no``; a point has an odd place between the even ones of counts.  Rows are added up
    inside their block, blocks by one row each, so a point is looked up without meeting any row.
    """
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (*KEY, "line_no")]
    both = counts.select(*KEY, "line_no", "n", *none).unionByName(points.withColumn("n", F.lit(0).cast("bigint")))
    inside = F.coalesce(F.sum("n").over(up_to_here()), F.lit(0))
    sums = both.groupBy(*KEY).agg(F.sum("n").alias("_n"))
    before = sums.select(*KEY, F.coalesce(F.sum("_n").over(earlier_blocks()), F.lit(0)).alias("_before"))
    counted = join_blocks(both.withColumn("_inside", inside), before).filter(F.col("sign").isNotNull())
    return counted.withColumn("upto", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "n")


def skipped(rows: DataFrame, pauses: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Rows each viewer missed while paused, per source: ``viewer, _src, skipped``.

    ``rows`` has ``arrival`` and ``_src``; ``pauses`` has ``viewer, pause_from, pause_to`` and
    optionally ``only_src``.  What a pause missed of a source is the difference of two running
    counts: that up to its end and that before its beginning.  Rows are counted per source and
    minute; the minutes of a day are added up, and the days.  Fine times are looked at only in
    the minutes in which a pause begins or ends.  The work grows with the minutes that hold
    rows and with the rows of the result, not with the length of the pauses.
    """
    width = bucket_seconds * 1_000_000
    a_day = max(1, 86_400 // bucket_seconds)
    at = utc.div(F.col("us"), width)
    arrivals = settle_keys(rows.select("_src", F.lit(0).cast("bigint").alias("block"), F.unix_micros("arrival").alias("us")).filter("us is not null"))
    arrivals = arrivals.groupBy("_src", "us").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", at)
    minutes = arrivals.groupBy("_src", "bucket").agg(F.sum("n").alias("n"))
    p = pauses.select(
        "viewer",
        F.unix_micros("pause_from").alias("lo"),
        F.unix_micros("pause_to").alias("hi"),
        (F.col("only_src") if "only_src" in pauses.columns else F.lit(None).cast("string")).alias("only_src"),
    ).filter(F.col("lo") <= F.col("hi"))
    # A pause without a source of its own is asked of every source: as many rows as the result has.
    every = minutes.agg(F.array_sort(F.collect_set("_src")).alias("s")).scalar()
    asked = p.withColumn("_src", F.explode(F.when(F.col("only_src").isNull(), every).otherwise(F.array("only_src"))))
    # Up to and with the end; up to but without the beginning.
    ends = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("hi").alias("us")), F.struct(F.lit(-1).alias("sign"), (F.col("lo") - 1).alias("us"))))
    points = asked.select("viewer", "_src", ends.alias("p")).select("viewer", "_src", "p.sign", "p.us").withColumn("bucket", at)

    whole = _counted_up_to(
        minutes.select("_src", utc.div(F.col("bucket"), a_day).alias("block"), (F.col("bucket") * 2).alias("line_no"), "n"),
        points.select("_src", utc.div(F.col("bucket"), a_day).alias("block"), (F.col("bucket") * 2 - 1).alias("line_no"), "viewer", "sign"),
    )
    edge = points.select("_src", "bucket").distinct()
    inside = arrivals.join(edge, ["_src", "bucket"], "left_semi")
    line = Window.partitionBy("_src", "bucket").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = inside.select("_src", "bucket", (F.col("us") * 2).alias("line_no"), "n", F.lit(None).cast(points.schema["viewer"].dataType).alias("viewer"), F.lit(None).cast("int").alias("sign"))
    fine = fine.unionByName(points.select("_src", "bucket", (F.col("us") * 2 + 1).alias("line_no"), F.lit(0).cast("bigint").alias("n"), "viewer", "sign"))
    partial = fine.withColumn("upto", F.sum("n").over(line)).filter(F.col("sign").isNotNull())

    both = whole.select("viewer", "_src", "sign", "upto").unionByName(partial.select("viewer", "_src", "sign", "upto"))
    found = both.groupBy("viewer", "_src").agg(F.sum(F.col("sign") * F.col("upto")).alias("skipped")).filter("skipped > 0")
    return found.withColumn("_src", F.nullif("_src", F.lit(NO_SOURCE)))


def order_by_arrival(stream: DataFrame, src: str = "_src", value: str = "value", order: str = "offset") -> DataFrame:
    """Shape any stream (Kafka, socket, …) for ``fold_stream``: text in ``value``, position in ``order``."""
    return stream.select(
        F.col(src).alias("_src"),
        F.lit(0).cast("long").alias("block"),
        F.col(order).cast("long").alias("line_no"),
        F.col(value).cast("string").alias("value"),
        *[F.col(c) for c in ("source_mtime", "flush") if c in stream.columns],
    )


def stream_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows a live ingest has stored."""
    return store.read_store(spark, path)


def latest_per_source(rows: DataFrame, n: int) -> DataFrame:
    """The newest rows of each source, for a live screen; the rank filter runs per task first."""
    newest = Window.partitionBy("_src").orderBy(F.desc("timestamp"), F.desc("_id"))
    return rows.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= n).drop("n")
