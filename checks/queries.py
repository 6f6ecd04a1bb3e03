"""One query per operator, over the driver's tables.

Times are returned as microseconds since the epoch, so that engines agree on them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions import predicates as q
from brooklog.functions import relative
from brooklog.functions import timeparse as tp
from brooklog.functions import utc
from brooklog.functions.grok import Pattern
from brooklog.operators import deep_paging, display, extract, fold, histogram, ordering, paging, summary, tagging, timeres
from brooklog.operators.timeres import TimeConfig
from brooklog.plans.ingest import IngestOptions, preview
from brooklog.plans.search import search
from brooklog.plans.views import View, run_views, view_histograms, view_page
from brooklog.sources import lines as li
from brooklog.sources import store
from brooklog.streaming import live
from checks.tables import document_lines, document_log, event_lines, event_log, event_records, table, timed_events

Query = Callable[[SparkSession, str], DataFrame]

UTC = dt.timezone.utc
START, END = dt.datetime(2024, 1, 3, tzinfo=UTC), dt.datetime(2024, 1, 8, tzinfo=UTC)
NOW = dt.datetime(2024, 1, 25, 12, tzinfo=UTC)
ANCHOR = dt.datetime(2024, 1, 1, 23, 59, 59, tzinfo=UTC)
LATER = dt.datetime(2024, 1, 20, tzinfo=UTC)
HEADER = "^(The|Is|And|En|Der|De|To|In|La|It) "

PLAIN = Pattern(
    "plain", r"^%{TIMESTAMP_ISO8601:timestamp} %{WORD:type} user=%{INT:user} k=%{INT:k}$", 5,
    timestamp_field="timestamp", timestamp_layout="2006-01-02 15:04:05",
)
PAIRS = Pattern("pairs", r'^ts=%{TIMESTAMP_ISO8601:timestamp} type=%{WORD:type} user=%{INT:user} msg="%{DATA:message}"$', 3)
LOOSE = Pattern("loose", "user=%{INT:user}", 1)
LIBRARY = (PLAIN, PAIRS, LOOSE)

RULES = (
    tagging.Rule("_src", "eq", "ERROR", "red"),
    tagging.Rule("value", "regex", r"^9\d\.", "high"),
    tagging.Rule("_raw", "contains", "USER1", "ones"),
    tagging.Rule("k", "eq", "7", "off", enabled=False),
    tagging.Rule("k", "neq", "5", "rest"),
    tagging.Rule("user_id", "exists", "", "any"),
)
us = F.unix_micros


def _page(df: DataFrame) -> DataFrame:
    return df.select(us("timestamp").alias("ts_us"), "_id", "_src", F.col("_seq").alias("seq"), F.col("attrs")["value"].alias("value"))


def asked(df: DataFrame) -> DataFrame:
    """The flagship question: which error and click events over 50 in these five days?"""
    return df.filter(q.in_window(START, END) & q.from_sources(["error", "click"]) & q.num_range("value", gt=50))


def _on_events(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(event_log(spark, sf))


def _docs_where(make: Callable[[], object]) -> Query:
    return lambda spark, sf: document_log(spark, sf).filter(make()).select(F.col("_seq").alias("doc_id"))


def _dist(df: DataFrame) -> DataFrame:
    return df.select("bucket", us("bucket_start").alias("start_us"), us("bucket_end").alias("end_us"), F.col("count").alias("n"))


def distribution_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = histogram.distribution(event_log(spark, sf), START, END, ["error", "click"])
    return d.select("bucket", F.col("count").alias("n"), *[F.coalesce(F.col("source_counts")[s], F.lit(0)).alias(f"n_{s}") for s in ("error", "click")])


def distribution_auto(spark: SparkSession, sf: str) -> DataFrame:
    d = histogram.distribution_auto(event_log(spark, sf))
    return d.select("bucket", us("bucket_start").alias("start_us"), F.col("_src").alias("src"), F.col("count").alias("n"))


def distribution_auto_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    d = histogram.distribution_auto(o.select(F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderpriority").alias("_src")))
    return d.select("bucket", us("bucket_start").alias("start_us"), F.col("_src").alias("src"), F.col("count").alias("n"))


def page_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li_ = table(spark, sf, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp")
    df = li_.select(
        ts.alias("timestamp"), F.to_date(ts).alias("log_date"), F.col("l_returnflag").alias("_src"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_seq"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("_id"),
        F.create_map(F.lit("quantity"), F.col("l_quantity").cast("string"), F.lit("tax"), F.col("l_tax").cast("string")).alias("attrs"),
    )
    hit = df.filter(q.from_sources(["R"]) & q.num_range("quantity", ge=30, lt=40))
    return paging.page(hit, 200, 100, "asc", "quantity").select("_id", F.col("_seq").alias("seq"), F.col("attrs")["quantity"].cast("double").alias("quantity"))


def page_after(spark: SparkSession, sf: str) -> DataFrame:
    key = paging.LastKey(dt.datetime(2024, 1, 15, tzinfo=UTC), 5000, "x")
    return _page(paging.page_after(event_log(spark, sf), key, 50))


def term_any_field(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.filter(q.term("track", [F.col("url"), F.col("html")]) | q.term("ref", [F.col("url"), F.col("html")])).select("page_id")


def regex_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter(q.regex(r"/[0-9]{2}\?page=", F.col("url"), on="text")).select("page_id")


def available_columns(spark: SparkSession, sf: str) -> DataFrame:
    return summary.available_columns(event_log(spark, sf)).select(F.col("column").alias("name"))


def null_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a source are numbered and carried like a source of their own."""
    df = timed_events(spark, sf, value=F.col("value")).withColumn("_src", F.nullif("_src", F.lit("error")))
    held = ordering.carry(ordering.with_seq(df), {"held": F.when(F.col("line_no") % 3 == 0, F.col("line_no"))})
    return held.select(F.col("line_no").alias("event_id"), F.col("_src").alias("src"), F.col("_seq").alias("seq"), "held")


def in_window_zone(spark: SparkSession, sf: str) -> DataFrame:
    """A window stated in New York, over the end of a UTC day."""
    start = dt.datetime(2024, 1, 4, 20, tzinfo=ZoneInfo("America/New_York"))
    return event_log(spark, sf).filter(q.in_window(start, start.replace(hour=23))).select(F.col("_seq").alias("event_id"))


def in_last_zone(spark: SparkSession, sf: str) -> DataFrame:
    """The last nine hours as asked in Tokyo on the morning of a day that has not begun in UTC."""
    now = dt.datetime(2024, 1, 5, 6, tzinfo=ZoneInfo("Asia/Tokyo"))
    return event_log(spark, sf).filter(relative.in_last(9, "hours", now)).select(F.col("_seq").alias("event_id"))


def retain_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Ten days before 2 a.m. in Tokyo is still the day before in UTC."""
    kept = store.retain(event_log(spark, sf), dt.timedelta(days=10), dt.datetime(2024, 1, 25, 2, tzinfo=ZoneInfo("Asia/Tokyo")))
    return kept.groupBy(F.col("log_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def drill_dst(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of a day of 23 hours."""
    moved = event_log(spark, sf).withColumn("timestamp", F.timestamp_micros(us("timestamp") + 60 * 86_400_000_000))
    zone = ZoneInfo("America/New_York")
    start, end = dt.datetime(2024, 3, 9, 12, tzinfo=zone), dt.datetime(2024, 3, 11, 12, tzinfo=zone)
    return _dist(histogram.drill(model.with_log_date(moved), start, end, 10, 89)[2])


def mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Full dates, dates without a year and bare times in one source, settled by its profile.

    A source with full dates has no rollover, so a bare time takes the last day that was named.
    """
    full = (F.col("user_id") < 40) | (F.col("event_id") < 60)
    df = timed_events(
        spark, sf, timestamp=F.when(full, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("user_id") < 70, F.date_format("ts", "MMM dd HH:mm:ss")),
        time=F.when(~full & (F.col("user_id") >= 70), F.date_format("ts", "HH:mm:ss")),
    )
    return _resolved(timeres.resolve(df, profile=timeres.profile_time(df, now=NOW)))


def store_days(spark: SparkSession, sf: str) -> DataFrame:
    """The overview of a store, with made-up file names and sizes."""
    rows = event_log(spark, sf).withColumns({"file": F.concat_ws("/", "log_date", "_src"), "size": F.length("_src").cast("long")})
    return store.info(rows)["days"].select(F.col("log_date").cast("string").alias("day"), F.col("rows").alias("n"), F.col("bytes").alias("n_bytes"))


def drill(spark: SparkSession, sf: str) -> DataFrame:
    return _dist(histogram.drill(event_log(spark, sf), START, END, 40, 20)[2])


def fit_window(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.fit_window(event_log(spark, sf)).select(us("start").alias("start_us"), us("end").alias("end_us"))


def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    users = event_log(spark, sf).withColumn("_src", F.col("attrs")["user_id"])
    return summary.top_sources(users, 8)


def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.extract(event_records(spark, sf), PLAIN.pattern, name="plain")
    a = F.col("attrs")
    return got.select("line_no", "matched", "error", *[a[k].alias(f"f_{k}") for k in ("timestamp", "type", "user", "k", "message")])


def extract_first(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.extract_first(event_records(spark, sf), LIBRARY[:2])
    return got.select("line_no", "pattern", F.col("attrs")["user"].alias("f_user"), F.size("attrs").alias("n_fields"))


def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.split_matched(extract.extract_first(event_records(spark, sf), LIBRARY[:2]))[1]
    return got.select("line_no", "error", F.col("attrs")["message"].alias("message"))


def parse_summary(spark: SparkSession, sf: str) -> DataFrame:
    return extract.parse_summary(extract.extract(event_records(spark, sf), PLAIN.pattern)).withColumnRenamed("_src", "src")


def suggest(spark: SparkSession, sf: str) -> DataFrame:
    return extract.suggest(event_records(spark, sf), LIBRARY).withColumnRenamed("_src", "src").withColumn("coverage", F.round("coverage", 9))


def suggest_multi(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.suggest_multi(event_records(spark, sf), LIBRARY[:2])
    return got.select(F.col("_src").alias("src"), "rank", "name", F.round("coverage", 9).alias("coverage"), F.round("combined", 9).alias("combined"))


def smart_decode(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.smart_decode(document_log(spark, sf))
    return got.select(F.col("_seq").alias("doc_id"), *[F.array_join(c, "|").alias(c[1:]) for c in extract.SMART])


def smart_decode_pages(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.smart_decode(table(spark, sf, "pages"), "html")
    return got.select("page_id", *[F.size(c).alias(f"n{c}") for c in extract.SMART])


def with_meta(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.with_meta(event_log(spark, sf), {"_src": "file.events", "k": "0", "env": "dev"})
    a = F.col("attrs")
    return got.groupBy(F.col("_src").alias("src"), a["k"].alias("k"), a["env"].alias("env")).agg(F.count(a["value"]).alias("n"))


def num_view(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers out of mixed text: every word of every document line, where it is a number."""
    words = document_lines(spark, sf).select("_src", F.explode(F.split("line", r"[^0-9A-Za-z.+-]+")).alias("w"))
    got = extract.num_view(words.withColumn("attrs", F.create_map(F.lit("word"), "w")), ["word"])
    return got.groupBy(F.col("_src").alias("src")).agg(F.count("word").alias("n"), F.max("word").alias("largest"))


def _folded(df: DataFrame) -> DataFrame:
    return df.select(F.col("_src").alias("src"), F.col("block").alias("doc_id"), "line_no", "n_lines", "oversize", F.md5("_raw").alias("raw_md5"))


def detect_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fold.detect_fold(document_lines(spark, sf)).select(F.col("_src").alias("src"), "name", "mode", "score")


def trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).filter(fold.is_trace_continuation(F.col("line")))
    return lines.groupBy(F.col("_src").alias("src")).agg(F.count(F.lit(1)).alias("n"))


def turn_order(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    df = c.select(F.col("conv_id").cast("string").alias("_src"), F.floor(F.col("turn") / 3).cast("long").alias("block"), F.col("turn").alias("line_no"))
    return ordering.with_seq(df).select(F.col("_src").alias("conv"), F.col("line_no").alias("turn"), F.col("_seq").alias("seq"))


_SHAPES = (
    "yyyy-MM-dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss '+0200'", "yyyy-MM-dd-HH.mm.ss", "MMM dd yyyy HH:mm:ss",
    "yyyy/MM/dd'T'HH:mm:ss'Z'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
)


def parse_ts(spark: SparkSession, sf: str) -> DataFrame:
    """Every event time is printed in one of nine ways and read back."""
    ts = F.col("ts").cast("timestamp")
    text, epoch = None, F.unix_micros(utc.from_wall("ts"))
    ways = [F.date_format(ts, s) for s in _SHAPES] + [F.call_function("div", epoch, F.lit(n)).cast("string") for n in (1_000_000, 1000, 1)]
    for i, way in enumerate(ways):
        text = F.when(F.col("event_id") % 9 == i, way) if text is None else text.when(F.col("event_id") % 9 == i, way)
    df = tp.with_parsed_ts(table(spark, sf, "events").withColumn("text", text), "p", F.col("text"))
    moment = tp.to_utc(tp.wall_micros(F.col("p.y"), F.col("p.mo"), F.col("p.d"), F.col("p.tod")), F.col("p.zone"))
    return df.select("event_id", us(moment).alias("ts_us"))


def _resolved(df: DataFrame) -> DataFrame:
    return df.select(F.col("line_no").alias("event_id"), us("timestamp").alias("ts_us"), F.col("ts_confidence").alias("confidence"))


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of users under 40 carry a time; the others take the one before."""
    shown = F.when((F.col("user_id") < 40), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return _resolved(timeres.resolve(timed_events(spark, sf, timestamp=shown), TimeConfig(anchor=ANCHOR, rollover=False, dated=True)))


def rollover_days(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the time of day alone; the days are counted from the jumps back."""
    return _resolved(timeres.resolve(timed_events(spark, sf, time=F.date_format("ts", "HH:mm:ss,SSSSSS")), TimeConfig(anchor=ANCHOR)))


def rollover_years(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without a year that pass New Year."""
    early = F.col("ts") - F.expr("interval 15 days")
    return _resolved(timeres.resolve(timed_events(spark, sf, timestamp=F.date_format(early, "MMM dd HH:mm:ss")), TimeConfig(anchor=LATER)))


def two_digit_year(spark: SparkSession, sf: str) -> DataFrame:
    """Two-digit years from three centuries' ends, never after the anchor's year."""
    df = timed_events(
        spark, sf, year=F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"),
        month=F.lit("2"), day=F.lit("3"), time=F.date_format("ts", "HH:mm:ss"),
    )
    return _resolved(timeres.resolve(df, TimeConfig(anchor=LATER, rollover=False, dated=True)))


def forced_date(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    cfg = TimeConfig(anchor=LATER, rollover=False, dated=True, forced_year=2020, forced_month=2, forced_day=30, force_mode="overwrite", year_strategy="forced", zone="-03:30")
    return _resolved(timeres.resolve(timed_events(spark, sf, timestamp=stamp), cfg))


def synthetic_ts(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(timeres.resolve(timed_events(spark, sf, user=F.col("user_id")), TimeConfig(anchor=LATER, synthetic=True)))


def component_times(spark: SparkSession, sf: str) -> DataFrame:
    """Date, hour, minute, second, milliseconds and zone in fields of their own."""
    df = timed_events(
        spark, sf, date=F.date_format("ts", "yyyyMMdd"), hour=F.hour("ts"), minute=F.minute("ts"), second=F.second("ts"),
        millis=F.date_format("ts", "SSS"), tz=F.lit("+02:00"),
    )
    return _resolved(timeres.resolve(df, TimeConfig(anchor=LATER, rollover=False, dated=True)))


def _mixed_times(spark: SparkSession, sf: str) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts")
    return timed_events(
        spark, sf,
        timestamp=F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(kind == "click", F.date_format(ts, "MMM dd HH:mm:ss")),
        year=F.when(kind == "error", F.date_format(ts, "yy")), time=F.when(kind == "error", F.date_format(ts, "HH:mm:ss")),
        created_at=F.when(kind == "signup", F.unix_timestamp(ts)), user=F.col("user_id"),
    )


def profile_time(spark: SparkSession, sf: str) -> DataFrame:
    p = timeres.profile_time(_mixed_times(spark, sf), now=NOW)
    return p.select(
        F.col("_src").alias("src"), "status", F.array_join("components", "|").alias("components"), "year_width", "anchor_kind",
        us("anchor").alias("anchor_us"), "year_strategy", "rollover", "source_field", "source_format",
    )


def time_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return timeres.time_candidates(_mixed_times(spark, sf)).select(F.col("_src").alias("src"), "name", "sample", "parses", "score", "rank")


def _quality_rows(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.when((F.col("user_id") < 40), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return timeres.resolve(timed_events(spark, sf, timestamp=shown), TimeConfig(anchor=ANCHOR, rollover=False, dated=True))


def time_quality(spark: SparkSession, sf: str) -> DataFrame:
    t = timeres.time_quality(_quality_rows(spark, sf))
    return t.select(F.col("_src").alias("src"), F.col("ts_confidence").alias("confidence"), F.col("count").alias("n"))


def time_examples(spark: SparkSession, sf: str) -> DataFrame:
    t = timeres.time_examples(_quality_rows(spark, sf), 5)
    return t.select(F.col("_src").alias("src"), F.col("ts_confidence").alias("confidence"), "n", "resolved", F.col("captured")["timestamp"].alias("captured"))


def tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.tag(event_log(spark, sf), RULES).select(F.col("_seq").alias("event_id"), "tag", "tag_rule")


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.tag_counts(event_log(spark, sf), RULES).withColumnRenamed("count", "n")


def views(spark: SparkSession, sf: str) -> DataFrame:
    v = run_views(event_log(spark, sf), _views(), NOW)
    return v.select("view_id", F.col("count").alias("n"), us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), F.size("histogram").alias("n_buckets"))


def _views() -> list[View]:
    return [
        View("errors", sources=("error",), preset="last-7-days"),
        View("costly", where=q.num_range("value", ge=80), preset="custom", count=3, unit="days"),
        View("five days", preset=None, start=START, end=END),
        View("none", where=q.term("nowhere")),
    ]


def view_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return view_histograms(event_log(spark, sf), _views(), NOW).select("view_id", "bucket", F.col("count").alias("n"))


def one_view(spark: SparkSession, sf: str) -> DataFrame:
    view = View("errors", sources=("error",), preset="last-7-days", columns=("user_id", "value"), rules=RULES[1:])
    return view_page(event_log(spark, sf), view, NOW, 50).select(us("timestamp").alias("ts_us"), "user_id", "value", "tag")


def in_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Wall clocks over a whole year, with both changes of the clocks."""
    shown = relative.in_zone(F.timestamp_micros(us("timestamp") + (F.col("_seq") % 340) * 86_400_000_000), "America/New_York")
    return event_log(spark, sf).select(F.col("_seq").alias("event_id"), F.date_format(shown, "yyyy-MM-dd HH:mm:ss").alias("shown"))


def highlight(spark: SparkSession, sf: str) -> DataFrame:
    marks = [display.Mark("ERROR"), display.Mark(r"user1\d", is_regex=True), display.Mark("2024", excluded=True)]
    rows = display.highlight(asked(event_log(spark, sf)), marks)
    return rows.select(F.col("_seq").alias("event_id"), "highlighted")


def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    df = model.with_log_date(event_log(spark, sf).drop("log_date", "_id"))
    return model.with_row_id(df).select("_id", F.col("log_date").cast("string").alias("log_date"))


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Errors come again with a new text, twice; the copy with the higher sequence stays."""
    rows = event_log(spark, sf).select("_id", "_raw", "_src", "_seq")
    fresh = rows.filter("_src = 'error'")
    new = fresh.withColumn("_raw", F.lit("first")).unionByName(fresh.withColumns({"_raw": F.lit("second"), "_seq": F.col("_seq") + 1}))
    return store.upsert_rows(rows, new).groupBy(F.col("_src").alias("src"), F.when(F.col("_src") == "error", F.col("_raw")).alias("raw")).agg(F.count(F.lit(1)).alias("n"), F.sum("_seq").alias("seq_sum"))


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids to delete: rows of the busiest users, and as many ids that do not exist."""
    ids = event_log(spark, sf).filter(q.num_range("user_id", lt=20)).select("_id")
    return ids.unionByName(ids.select(F.concat(F.lit("x"), "_id").alias("_id")))


def delete_ids(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = store.delete_ids(event_log(spark, sf), _ids(spark, sf))
    return kept.groupBy(F.col("_src").alias("src")).agg(F.count(F.lit(1)).alias("n"), F.sum("_seq").alias("seq_sum"))


def delete_count(spark: SparkSession, sf: str) -> DataFrame:
    return store.delete_ids(event_log(spark, sf), _ids(spark, sf))[1]


def retain(spark: SparkSession, sf: str) -> DataFrame:
    kept = store.retain(event_log(spark, sf), dt.timedelta(days=10), NOW)
    return kept.groupBy(F.col("log_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def validate_lines(spark: SparkSession, sf: str) -> DataFrame:
    ok, rejected = li.validate_lines(document_lines(spark, sf), 400)
    both = ok.withColumn("kind", F.lit("ok")).unionByName(rejected.withColumn("kind", F.lit("rejected")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("bytes"))


def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Export read back: only the JSON text is looked at."""
    text = store.export_frame(asked(event_log(spark, sf)))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return text.select(get("_id").alias("id"), get("value").cast("double").alias("value"), get("timestamp").alias("ts"))


def select_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = display.select_columns(event_log(spark, sf), ["k", "_src"])
    return df.select(us("timestamp").alias("ts_us"), "k", F.col("_src").alias("src"))


def skipped_while_paused(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation is a viewer that paused for 36 hours."""
    n = table(spark, sf, "nation")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("n_nationkey") * 86400)
    pauses = n.select(F.col("n_name").alias("viewer"), start.alias("pause_from"), (start + F.expr("interval 36 hours")).alias("pause_to"))
    rows = event_log(spark, sf).select(F.col("timestamp").alias("arrival"), "_src")
    return live.skipped(rows, pauses).select("viewer", F.col("_src").alias("src"), "skipped")


def skipped_for_a_year(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation is a viewer that paused for a year; every fifth watches one source only."""
    n = table(spark, sf, "nation")
    start = F.timestamp_micros(F.lit(1704067200_123456) + F.col("n_nationkey") * 90_000_000_000)
    only = F.when(F.col("n_nationkey") % 5 == 0, "click")
    pauses = n.select(F.col("n_name").alias("viewer"), start.alias("pause_from"), (start + F.expr("interval 365 days")).alias("pause_to"), only.alias("only_src"))
    rows = event_log(spark, sf).select(F.col("timestamp").alias("arrival"), "_src")
    return live.skipped(rows, pauses).select("viewer", F.col("_src").alias("src"), "skipped")


def page_deep(spark: SparkSession, sf: str) -> DataFrame:
    """The page in the middle of all events."""
    log = event_log(spark, sf)
    return _page(deep_paging.page_deep(log, 200, log.count() // 2, few=500))


def page_deep_by_field(spark: SparkSession, sf: str) -> DataFrame:
    """The page in the middle of all line items by quantity, of which there are fifty."""
    rows = table(spark, sf, "lineitem").select(
        F.lit(None).cast("timestamp").alias("timestamp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_seq"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("_id"), F.create_map(F.lit("quantity"), F.col("l_quantity").cast("string")).alias("attrs"),
    )
    found = deep_paging.page_deep(rows, 300, rows.count() // 2, "asc", "quantity", few=500)
    return found.select("_id", F.col("_seq").alias("seq"), F.col("attrs")["quantity"].cast("double").alias("quantity"))


def search_page(spark: SparkSession, sf: str) -> DataFrame:
    r = search(event_log(spark, sf), q.num_range("value", gt=50), START, END, ["error", "click"], sort_by="value", order="asc", limit=50, offset=10)
    return r.page.select("_id", F.col("attrs")["value"].alias("value"))


def search_totals(spark: SparkSession, sf: str) -> DataFrame:
    return search(event_log(spark, sf), q.num_range("value", gt=50), START, END, limit=50, offset=10_000_000).totals


def ingest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of three formats all the way to log rows."""
    opts = IngestOptions(patterns=LIBRARY[:2], meta={"env": "dev"}, time=TimeConfig(anchor=ANCHOR, rollover=False, dated=True))
    rows = preview(event_lines(spark, sf), opts)
    return rows.select("_id", us("timestamp").alias("ts_us"), F.col("_src").alias("src"), "error", F.col("attrs")["user"].alias("f_user"), "ts_confidence")


HINTED = (
    Pattern("bracket", r"^\[%{DATA:seen}\] user=%{INT:user}$", timestamp_field="seen", timestamp_layout="02 Jan 2006 15h04m05s"),
    Pattern("epoch", r"^at=%{INT:at} user=%{INT:user}$", timestamp_field="at", timestamp_layout="unix_millis"),
    Pattern("tail", r"user=%{INT:user}1$", 9),
)


def ingest_hint(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources with lines and time layouts of their own; each is parsed by the pattern that fits it, its time read by that pattern's hint."""
    at = utc.from_wall("ts")
    user = F.concat(F.lit(" user="), F.col("user_id"))
    shown = F.concat(F.lit("["), F.date_format("ts", "dd MMM yyyy HH'h'mm'm'ss's'"), F.lit("]"), user)
    epoch = F.concat(F.lit("at="), utc.div(us(at), 1_000_000).cast("string"), F.lit("000"), user)
    events = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    lines = events.select(
        F.col("event_type").alias("_src"), F.floor(F.col("event_id") / 1000).cast("long").alias("block"), F.col("event_id").alias("line_no"),
        F.when(F.col("event_type") == "click", shown).otherwise(epoch).alias("line"),
    )
    rows = preview(lines, IngestOptions(patterns=HINTED, choose=True, time=TimeConfig(anchor=ANCHOR, rollover=False, dated=True)))
    return rows.select("_id", us("timestamp").alias("ts_us"), F.col("_src").alias("src"), F.col("attrs")["user"].alias("f_user"), "ts_confidence")


QUERIES: dict[str, Query] = {
    "ingest_hint": ingest_hint,
    "page_desc": _on_events(lambda d: _page(paging.page(asked(d), 100, 20))),
    "page_by_field": page_lineitem,
    "page_summary": _on_events(lambda d: paging.page_summary(asked(d), 100, 20)),
    "page_after": page_after,
    "page_deep": page_deep,
    "page_deep_by_field": page_deep_by_field,
    "skipped_for_a_year": skipped_for_a_year,
    "latest_n": _on_events(lambda d: _page(paging.latest(d, 1000))),
    "dropped": _on_events(lambda d: paging.dropped(d, 1000)),
    "bounds": _on_events(lambda d: summary.bounds(d).select(us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))),
    "total": _on_events(lambda d: summary.total(asked(d))),
    "source_totals": _on_events(lambda d: summary.source_totals(d).select(F.col("_src").alias("src"), F.col("count").alias("n"))),
    "source_names": lambda s, f: summary.source_names(document_log(s, f)).select(F.col("_src").alias("src")),
    "day_counts": _on_events(lambda d: summary.day_counts(d).select(F.col("log_date").cast("string").alias("day"), F.col("count").alias("n"))),
    "top_sources": top_sources,
    "distribution": _on_events(lambda d: _dist(histogram.distribution(d, START, END))),
    "distribution_by_source": distribution_by_source,
    "distribution_auto": distribution_auto,
    "distribution_auto_orders": distribution_auto_orders,
    "drill": drill,
    "fit_window": fit_window,
    "available_columns": available_columns,
    "facets": _on_events(lambda d: summary.facets(d, ["user_id", "k", "_src"], 5).select("field", "value", F.col("count").alias("n"), "rank")),
    "column_fill": _on_events(lambda d: summary.column_fill(d).select(F.col("column").alias("name"), "filled", "priority")),
    "default_columns": _on_events(lambda d: summary.default_columns(d, 2).select(F.col("column").alias("name"))),
    "match_all": _docs_where(q.match_all),
    "term": _docs_where(lambda: q.term("was")),
    "field_term": _docs_where(lambda: q.term("FR", "lang")),
    "term_any_field": term_any_field,
    "phrase": _docs_where(lambda: q.phrase("of the")),
    "phrase_fuzzy": _docs_where(lambda: q.phrase("that was the", "_raw", fuzziness=1)),
    "wildcard_prefix": _docs_where(lambda: q.wildcard("erst*", "_raw")),
    "wildcard_suffix": _docs_where(lambda: q.wildcard("*tioning", "_raw")),
    "regex_term": _docs_where(lambda: q.regex("to(ken|wer)s?", "_raw")),
    "regex_text": regex_text,
    "fuzzy": _docs_where(lambda: q.fuzzy("tokem", 1, "_raw")),
    "bool_query": _docs_where(lambda: q.all_of(q.term("was"), q.any_of(q.term("en", "lang"), q.term("de", "lang"))) & q.none_of(q.phrase("of the"))),
    "num_range": _docs_where(lambda: q.num_range("n_chars", gt=1000, le=5000)),
    "num_eq": _docs_where(lambda: q.num_eq(250)),
    "ts_range": _docs_where(lambda: q.ts_range(gt=dt.datetime(2024, 1, 1, 5, tzinfo=UTC), le=dt.datetime(2024, 1, 1, 9, tzinfo=UTC))),
    "source_phrase": _docs_where(lambda: q.from_sources(["src1", "src3"], exact=False)),
    "no_sources": _docs_where(lambda: q.from_sources([])),
    "in_window": _on_events(lambda d: d.filter(q.in_window(START, END)).select(F.col("_seq").alias("event_id"))),
    "in_last": _on_events(lambda d: d.filter(relative.in_last("last-7-days", NOW)).select(F.col("_seq").alias("event_id"))),
    "in_last_units": _on_events(lambda d: d.filter(relative.in_last(1, "weeks", NOW) & ~relative.in_last(30, "hours", NOW)).select(F.col("_seq").alias("event_id"))),
    "select_columns": select_columns,
    "in_zone": in_zone,
    "highlight": highlight,
    "extract_fields": extract_fields,
    "extract_first": extract_first,
    "unmatched": unmatched,
    "parse_summary": parse_summary,
    "suggest": suggest,
    "suggest_multi": suggest_multi,
    "smart_decode": smart_decode,
    "smart_decode_pages": smart_decode_pages,
    "with_meta": with_meta,
    "num_view": num_view,
    "fold_header": lambda s, f: _folded(fold.fold(document_lines(s, f), "header", HEADER, max_lines=20)),
    "fold_indent": lambda s, f: _folded(fold.fold(document_lines(s, f), "indent", max_bytes=2000)),
    "detect_fold": detect_fold,
    "trace_lines": trace_lines,
    "turn_order": turn_order,
    "parse_ts": parse_ts,
    "component_times": component_times,
    "carry_forward": carry_forward,
    "rollover_days": rollover_days,
    "rollover_years": rollover_years,
    "two_digit_year": two_digit_year,
    "forced_date": forced_date,
    "synthetic_ts": synthetic_ts,
    "profile_time": profile_time,
    "mixed_dates": mixed_dates,
    "null_source": null_source,
    "in_window_zone": in_window_zone,
    "in_last_zone": in_last_zone,
    "retain_zone": retain_zone,
    "drill_dst": drill_dst,
    "store_days": store_days,
    "time_candidates": time_candidates,
    "time_quality": time_quality,
    "time_examples": time_examples,
    "tag_rows": tag_rows,
    "tag_counts": tag_counts,
    "run_views": views,
    "view_buckets": view_buckets,
    "view_page": one_view,
    "row_ids": row_ids,
    "upsert": upsert,
    "delete_ids": delete_ids,
    "delete_count": delete_count,
    "retain": retain,
    "validate_lines": validate_lines,
    "export_rows": export_rows,
    "skipped_while_paused": skipped_while_paused,
    "search_page": search_page,
    "search_totals": search_totals,
    "ingest_rows": ingest_rows,
}
