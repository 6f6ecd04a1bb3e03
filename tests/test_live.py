"""Streaming ingest gives what a batch over the same lines gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brooklog.operators import fold as fo
from brooklog.operators.timeres import TimeConfig
from brooklog.plans.ingest import IngestOptions, to_rows
from brooklog.sources import lines as li
from brooklog.streaming import live

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 5, 4, 12, tzinfo=UTC)


def drop(spark, folder, rows, name):
    """One file of the directory source: rows of (src, line_no, value, flush)."""
    df = spark.createDataFrame([(s, 0, n, v, f) for s, n, v, f in rows], "_src string, block long, line_no long, value string, flush boolean")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def source(spark, folder):
    schema = "_src string, block long, line_no long, value string, flush boolean"
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, folder, opts, work, published=None):
    publish = None if published is None else lambda df, n: published.append((n, [r.asDict() for r in df.collect()]))
    query = live.live_ingest(
        source(spark, folder), opts, f"{work}/rows", f"{work}/cp", publish, once=True, now=lambda: NOW
    )
    query.awaitTermination()


def stored(spark, work):
    return live.stream_rows(spark, f"{work}/rows").orderBy("_src", "_seq").collect()


TEXTS = {
    "a": ["2026-04-01 09:15:01 ERROR failed", "java.lang.IllegalStateException: closed", "\tat a.B.c(B.java:1)",
          "2026-04-01 09:15:02 INFO recovered", "stray"],
    "b": ["2026-04-01 10:00:00 INFO one", "2026-04-01 10:00:01 INFO two"],
}
ISO = IngestOptions(
    pattern=r"^%{TIMESTAMP_ISO8601:timestamp} %{LOGLEVEL:level} %{GREEDYDATA:message}", fold_mode="header", fold_header=fo.ISO_HEADER
)


def test_records_span_batches(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path)
    opts, published = live.LiveOptions(ISO), []
    drop(spark, folder, [("a", 0, TEXTS["a"][0], False), ("a", 1, TEXTS["a"][1], False), ("b", 0, TEXTS["b"][0], False)], "1")
    run(spark, folder, opts, work, published)
    assert sum(len(rows) for _, rows in published) == 0  # both records are still open
    drop(spark, folder, [("a", i, TEXTS["a"][i], False) for i in (2, 3, 4)] + [("b", 1, TEXTS["b"][1], False)], "2")
    run(spark, folder, opts, work, published)
    assert {r["_src"] for _, rows in published for r in rows} == {"a", "b"}
    drop(spark, folder, [("a", 9, None, True), ("b", 9, None, True)], "3")
    run(spark, folder, opts, work, published)
    rows = stored(spark, work)
    assert [(r._src, r._seq) for r in rows] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert "IllegalStateException" in rows[0]._raw and rows[1]._raw.endswith("recovered stray")
    assert all("_seq" not in r and r["_id"] for _, batch in published for r in batch)
    flat = [(s, 0, i, t) for s, texts in TEXTS.items() for i, t in enumerate(texts)]
    batch = to_rows(spark.createDataFrame(flat, "_src string, block long, line_no long, line string"), ISO, NOW)
    want = [(r._src, r._seq, r._raw, r.timestamp, r._id, r.attrs) for r in batch.orderBy("_src", "_seq").collect()]
    assert [(r._src, r._seq, r._raw, r.timestamp, r._id, r.attrs) for r in rows] == want


def test_clock_goes_on_over_batches(spark, tmp_path):
    texts = ["Dec 30 23:00:00 x", "Dec 31 23:59:59 y", "no time here", "Jan  1 00:00:01 z", "Jan  1 12:00:00 w"]
    opts = IngestOptions(pattern=r"^%{SYSLOGTIMESTAMP:timestamp} %{GREEDYDATA:message}")
    folder, work = str(tmp_path / "in"), str(tmp_path)
    for cut in ((0, 2), (2, 3), (3, 5)):
        drop(spark, folder, [("s", i, texts[i], False) for i in range(*cut)], str(cut[0]))
        run(spark, folder, live.LiveOptions(opts), work)
    rows = stored(spark, work)
    assert [str(r.timestamp) for r in rows] == [
        "2025-12-30 23:00:00", "2025-12-31 23:59:59", "2025-12-31 23:59:59", "2026-01-01 00:00:01", "2026-01-01 12:00:00",
    ]
    assert [r._seq for r in rows] == [1, 2, 3, 4, 5] and rows[2].error and rows[2].ts_confidence == "carried"
    flat = spark.createDataFrame([("s", 0, i, t) for i, t in enumerate(texts)], "_src string, block long, line_no long, line string")
    whole = to_rows(flat, IngestOptions(pattern=opts.pattern, time=TimeConfig(anchor=NOW)), NOW).orderBy("_seq").collect()
    assert [r.timestamp for r in whole] == [r.timestamp for r in rows]


def test_a_batch_keeps_its_moment(spark, tmp_path):
    """A second try of a batch gets the moment of the first; moments no batch asks for again go."""
    path, moments = str(tmp_path / "moments"), iter([NOW + dt.timedelta(days=i) for i in range(9)])
    ask = lambda number: live._moment_of(spark, path, number, lambda: next(moments))
    assert ask(0) == ask(0) == NOW
    assert ask(1) == ask(1) == NOW + dt.timedelta(days=1) and ask(0) == NOW
    ask(2)
    ask(3)
    assert len([f for f in (tmp_path / "moments").iterdir() if not f.name.startswith(".")]) == 2


def test_idle_source_is_flushed(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path)
    opts = live.LiveOptions(IngestOptions(fold_mode="indent"), idle_timeout="1 second", flush_interval="500 milliseconds")
    drop(spark, folder, [("s", 0, "first line", False), ("s", 1, "  continued", False)], "1")
    query = live.live_ingest(source(spark, folder), opts, f"{work}/rows", f"{work}/cp", now=lambda: NOW)
    try:
        for _ in range(60):
            if query.exception() or (query.recentProgress and _count(spark, work)):
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert [r._raw for r in stored(spark, work)] == ["first line   continued"]


def _count(spark, work):
    try:
        return live.stream_rows(spark, f"{work}/rows").count()
    except Exception:
        return 0


def test_directory_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("\n".join(f"line {i}\r" for i in range(300)) + "\n\n")
    df = li.live_lines(spark, str(tmp_path / "in"))
    query = live.live_ingest(df, live.LiveOptions(), f"{tmp_path}/rows", f"{tmp_path}/cp", once=True, now=lambda: NOW)
    query.awaitTermination()
    assert [r._raw for r in stored(spark, tmp_path)] == [f"line {i}" for i in range(300)]


def test_skipped_while_paused(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=UTC)
    s = lambda n: t + dt.timedelta(seconds=n)
    arrivals = [(s(i), "a" if i % 3 else "b") for i in range(0, 600, 7)]
    pauses = [("v1", s(10), s(20), None), ("v1", s(100), s(400), None), ("v2", s(0), s(599), "b"), ("v3", s(30), s(29), None)]
    rows = spark.createDataFrame(arrivals, "arrival timestamp, _src string")
    got = live.skipped(rows, spark.createDataFrame(pauses, "viewer string, pause_from timestamp, pause_to timestamp, only_src string"))
    want = {}
    for v, lo, hi, only in pauses:
        for at, src in arrivals:
            if lo <= at <= hi and only in (None, src):
                want[(v, src)] = want.get((v, src), 0) + 1
    assert {(r.viewer, r._src): r.skipped for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """A folder that is full at the start is read in several batches, and every line once."""
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.log").write_text(f"file {i} " + "x" * 1000 + "\n")
    df = li.live_lines(spark, str(tmp_path / "in"), max_bytes_per_trigger=2500)
    seen = []
    query = df.writeStream.foreachBatch(lambda b, n: seen.append([r.value[:6] for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(sum(seen, [])) == [f"file {i}" for i in range(6)] and max(map(len, seen)) <= 3 and len(seen) >= 2


def test_any_stream_can_be_shaped(spark):
    rate = spark.readStream.format("rate").load().selectExpr("'r' AS _src", "CAST(value AS STRING) AS line", "value AS offset")
    shaped = live.order_by_arrival(rate, value="line")
    assert shaped.columns == ["_src", "block", "line_no", "value"] and shaped.isStreaming
    with pytest.raises(ValueError):
        live.fold_stream(shaped, live.LiveOptions(IngestOptions(fold_mode="header")))


def test_latest_per_source(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame([(t + dt.timedelta(seconds=i), "ab"[i % 2], str(i)) for i in range(10)], "timestamp timestamp, _src string, _id string")
    assert {r._id for r in live.latest_per_source(df, 2).collect()} == {"9", "8", "7", "6"}
    assert df.filter(F.col("_src") == "a").count() == 5
