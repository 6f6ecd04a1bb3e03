"""Reading lines, the day store, and the whole ingest."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions import predicates as q
from brooklog.operators import fold as fo
from brooklog.plans.ingest import IngestOptions, ingest, preview
from brooklog.sources import lines as li
from brooklog.sources import store

UTC = dt.timezone.utc


def test_line_rules(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbffirst\r\n\nlone\rcr\n  \r\n\r\nlast")
    df = li.read_lines(spark, str(tmp_path)).orderBy("block", "line_no")
    assert [r.line for r in df.collect()] == ["first", "lone\rcr", "  ", "last"]
    assert li.with_file_name(df, "file.").first()._src == "file.a.log"
    ok, rejected = li.validate_lines(df, 5)
    assert ok.count() == 3 and [r.line for r in rejected.collect()] == ["lone\rcr"]


def test_order_over_many_splits(spark, tmp_path):
    texts = [f"{i:05d} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "big.log").write_text("\n".join(texts))
    (tmp_path / "small.log").write_text("s1\ns2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = li.with_file_name(li.read_lines(spark, str(tmp_path)))
        rows = df.orderBy("_src", "block", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r.block for r in rows}) > 10
    assert [r.line for r in rows if r._src == "big.log"] == texts
    assert [r.line for r in rows if r._src == "small.log"] == ["s1", "s2"]


@pytest.fixture
def rows(spark):
    t = dt.datetime(2024, 1, 1, 12, tzinfo=UTC)
    df = spark.createDataFrame(
        [(t + dt.timedelta(days=i % 3, minutes=i), f"r{i}", "s", i, None, {"n": str(i), "w": "x"}) for i in range(9)],
        "timestamp timestamp, _raw string, _src string, _seq long, error string, attrs map<string,string>",
    )
    return model.with_row_id(model.with_log_date(df))


def test_store_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    store.append(rows, path)
    day = dt.datetime(2024, 1, 2, tzinfo=UTC)
    one = store.scan(spark, path, day, day)
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    window = store.read_store(spark, path).filter(q.in_window(day, day + dt.timedelta(hours=1)))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "GreaterThanOrEqual(timestamp" in plan
    info = store.store_info(spark, path)
    total = info["total"].first()
    assert (total.days, total.rows) == (3, 9) and total.bytes > 0
    assert [r._src for r in info["sources"].collect()] == ["s"]

    ids = [r._id for r in rows.filter("_seq in (0, 3, 6, 1)").collect()]
    assert store.delete_from_store(spark, path, [*ids, "no-such-id", ""]) == 4
    left = store.read_store(spark, path)
    assert {r._seq for r in left.collect()} == {2, 4, 5, 7, 8}

    new = rows.filter("_seq in (1, 2)").withColumn("_raw", F.lit("new"))
    store.upsert(spark, path, new)
    after = {r._seq: r._raw for r in store.read_store(spark, path).collect()}
    assert after == {1: "new", 2: "new", 4: "r4", 5: "r5", 7: "r7", 8: "r8"}

    now = dt.datetime(2024, 1, 5, tzinfo=UTC)
    assert store.retain_store(spark, path, dt.timedelta(0), now) == 0
    assert store.retain_store(spark, path, dt.timedelta(days=2), now) == 1
    assert {str(r.log_date) for r in store.read_store(spark, path).select("log_date").distinct().collect()} == {"2024-01-03"}


def test_row_level_forms(spark, rows):
    kept, n = store.delete_ids(rows, spark.createDataFrame([(r._id,) for r in rows.limit(2).collect()], "x string"))
    assert kept.count() == 7 and n.first().n_deleted == 2
    twice = rows.limit(1).withColumn("_raw", F.lit("a")).unionByName(rows.limit(1).withColumns({"_raw": F.lit("b")}))
    assert store.upsert_rows(rows, twice.withColumn("_seq", F.col("_seq")), "_raw").filter("_raw = 'b'").count() == 1
    assert store.upsert_rows(rows, twice, "_raw").count() == 9
    young = store.retain(rows, dt.timedelta(days=1), dt.datetime(2024, 1, 3, 0, 0, 1, tzinfo=UTC))
    assert young.select("log_date").distinct().count() == 1
    exact = store.retain(rows, dt.timedelta(days=1), dt.datetime(2024, 1, 3, tzinfo=UTC))
    assert exact.select("log_date").distinct().count() == 2


def test_export(spark, rows, tmp_path):
    store.export_jsonl(rows, str(tmp_path / "out"), max_rows=4)
    texts = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    got = [json.loads(t) for t in texts]
    assert [g["n"] for g in got] == [8, 5, 2, 7] and got[0]["w"] == "x" and got[0]["_src"] == "s" and "_seq" not in got[0]


JAVA = """2026-04-01 09:14:22 INFO  [exec-3] c.a.Ingest - started
2026-04-01 09:15:01 ERROR [exec-7] c.a.Store - failed to store batch
java.lang.IllegalStateException: index writer is closed
\tat c.a.Store.put(Store.java:214)
Caused by: java.io.IOException: No space left on device
\t... 6 more
2026-04-01 09:15:02 WARN  [exec-7] c.a.Ingest - retrying
not a header
"""
SYSLOG = """Dec 31 23:59:58 host app[1]: one
    detail
Jan  1 00:00:02 host app[1]: two
"""


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "java.log").write_text(JAVA)
    opts = IngestOptions(
        pattern=r"^%{TIMESTAMP_ISO8601:timestamp} +%{LOGLEVEL:level} +\[%{DATA:thread}\] %{NOTSPACE:logger} - %{GREEDYDATA:message}",
        name="java", fold_mode="header", fold_header=fo.ISO_HEADER, smart=True, meta={"env": "dev"},
    )
    path = str(tmp_path / "store")
    summary = ingest(spark, str(tmp_path / "in"), opts, path).first()
    assert (summary._src, summary.processed, summary.failed) == ("java.log", 3, 0)
    got = store.read_store(spark, path).orderBy("_seq").collect()
    assert [r._seq for r in got] == [1, 2, 3] and [str(r.timestamp) for r in got][1] == "2026-04-01 09:15:01"
    assert "Caused by" in got[1]._raw and got[1].attrs["level"] == "ERROR" and got[1].attrs["env"] == "dev"
    assert "timestamp" not in got[1].attrs and got[1].ts_confidence == "exact" and len({r._id for r in got}) == 3

    (tmp_path / "sys").mkdir()
    (tmp_path / "sys" / "sys.log").write_text(SYSLOG)
    lines = li.read_lines(spark, str(tmp_path / "sys")).withColumn(
        "source_mtime", F.timestamp_micros(F.lit(int(dt.datetime(2026, 1, 2, tzinfo=UTC).timestamp()) * 10**6))
    )
    sysopts = IngestOptions(
        pattern="%{SYSLOGTIMESTAMP:timestamp} %{HOSTNAME:host} %{GREEDYDATA:message}", fold_mode="indent", file_names=True
    )
    rows = preview(lines, sysopts).orderBy("timestamp").collect()
    assert [str(r.timestamp) for r in rows] == ["2025-12-31 23:59:58", "2026-01-01 00:00:02"]
    assert rows[0]._raw.endswith("one     detail") and rows[0]._src == "sys.log"


def test_too_long_line_stops_the_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("ok\n" + "y" * (li.MAX_LINE_BYTES + 1) + "\n")
    with pytest.raises(Exception, match="2 MiB"):
        ingest(spark, str(tmp_path / "in"), IngestOptions(), str(tmp_path / "store"))

def test_one_store_for_files_and_streams(spark, rows, tmp_path):
    """Rows of files and of stream batches share days; every way of changing the store keeps it readable."""
    path = str(tmp_path / "store")
    store.replace_batch(rows.filter("_seq < 5").withColumn("_urls", F.array(F.lit("http://x"))), path, 0)
    store.append(rows.filter("_seq >= 5"), path)
    assert store.read_store(spark, path).count() == 9
    assert store.read_store(spark, path).filter("_urls is not null").count() == 5
    store.replace_batch(rows.filter("_seq < 5"), path, 0)  # the same batch runs again
    assert store.read_store(spark, path).count() == 9
    ids = [r._id for r in rows.filter("_seq in (0, 3, 8)").collect()]
    assert store.delete_from_store(spark, path, [*ids, "nonsense", "17-gone-1"]) == 3
    assert {r._seq for r in store.read_store(spark, path).collect()} == {1, 2, 4, 5, 6, 7}
    store.upsert(spark, path, rows.filter("_seq in (1, 8)").withColumn("_raw", F.lit("new")))
    got = {r._seq: r._raw for r in store.read_store(spark, path).collect()}
    assert got == {1: "new", 2: "r2", 4: "r4", 5: "r5", 6: "r6", 7: "r7", 8: "new"}
    store.append(rows.filter("_seq = 0"), path)
    assert store.retain_store(spark, path, dt.timedelta(days=1), dt.datetime(2024, 1, 2, 23, tzinfo=UTC)) == 1
    assert {r._seq for r in store.read_store(spark, path).collect()} == {1, 4, 7, 2, 5, 8}
    assert store.store_info(spark, path)["total"].first().rows == 6


def test_days_of_other_zones(spark, rows, tmp_path):
    from zoneinfo import ZoneInfo

    path = str(tmp_path / "store")
    store.append(rows, path)
    evening = dt.datetime(2024, 1, 1, 20, tzinfo=ZoneInfo("America/New_York"))  # 2 January in UTC
    assert {r.log_date for r in store.scan(spark, path, evening, evening).collect()} == {dt.date(2024, 1, 2)}
    assert store.first_day_kept(dt.timedelta(days=10), dt.datetime(2024, 1, 25, 2, tzinfo=ZoneInfo("Asia/Tokyo"))) == dt.date(2024, 1, 15)
