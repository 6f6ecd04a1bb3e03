"""What the operators hold in memory: batches, slices, caches."""

import pyarrow as pa
from pyspark.sql import functions as F

from brooklog.llm import common, near_duplicates
from brooklog.llm.common import BATCH_BYTES, BATCH_SETTING, add_columns, held_by_worker, slices, through_table


def batch_sizes(spark):
    """Rows and bytes of the batches of 100 rows of 200,000 bytes, as Python gets them."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    rows = spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("x"), 200_000).alias("text"))
    return through_table(rows.mapInArrow(run, "n bigint, bytes bigint"), "sizes").collect()


def test_batches_to_python_are_bounded_in_bytes(spark):
    seen = batch_sizes(spark)
    assert sum(r["n"] for r in seen) == 100
    assert max(r["bytes"] for r in seen) <= BATCH_BYTES + 201_000
    assert spark.conf.get(BATCH_SETTING, None) is None


def test_a_size_that_the_session_sets_stays(spark):
    spark.conf.set(BATCH_SETTING, "1000000")
    try:
        seen = batch_sizes(spark)
        assert max(r["bytes"] for r in seen) <= 1_201_000
        assert spark.conf.get(BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_texts_become_python_strings_a_slice_at_a_time(spark):
    """Tracing starts in the first batch; in the second, of 40 texts and 20 MB, it sees the batch and one slice of strings."""

    def traced(texts):
        import tracemalloc

        if texts[0] == "first":
            tracemalloc.start()
            return [[0] * len(texts)]
        held = tracemalloc.get_traced_memory()[0]
        if texts[-1] == "last":
            tracemalloc.stop()
        return [[held] * len(texts)]

    text = F.when(F.col("id") == 0, "first").when(F.col("id") == 79, "last").otherwise(F.repeat(F.lit("x"), 500_000))
    rows = spark.range(0, 80, 1, 1).select("id", text.alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        held = add_columns(rows, "text", "held bigint", traced, ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(held) == 80
    assert 0 < max(r["held"] for r in held if r["id"] >= 40) < 30_000_000


def test_slices_count_characters_and_lose_no_text():
    texts = pa.array(["ab", None, "ééé", "", "x" * 9, "y", "z"])
    assert list(slices(texts, 5)) == [(0, 4), (4, 5), (5, 7)]
    assert list(slices(texts.slice(2), 5)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices(texts.slice(0, 0), 5)) == []


def test_memory_goes_back_when_another_operator_takes_the_worker(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_HELD", [])
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(common._HELD)))
    assert held_by_worker("a", lambda: 1) == 1
    assert held_by_worker("a", lambda: 2) == 1
    assert calls == []
    assert held_by_worker("b", lambda: 3) == 3
    assert calls == [0]
    monkeypatch.undo()
    common.give_back()


def test_keys_are_made_and_moved_once(spark):
    signatures = [(i, near_duplicates.signature(near_duplicates.shingle_set(t, 2))) for i, t in enumerate(["a b c d e f", "a b c d e f", "a b c d e g", "quite other words here", "", "one"]) if t]
    table = spark.createDataFrame(signatures, "id bigint, signature binary")
    found = near_duplicates.members_of(table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    by_key = {}
    for r in near_duplicates.keys_of(table).collect():
        by_key.setdefault(r["key"], set()).add(r["id"])
    assert sorted(map(tuple, found.collect())) == sorted((k, i, len(ids)) for k, ids in by_key.items() if len(ids) > 1 for i in ids)
    assert {0, 1} <= {r["id"] for r in found.collect()}


def test_clusters_under_a_key_are_found_without_joins(spark):
    rows = [(1, 10, 1, 7), (1, 11, 1, 7), (1, 12, 1, 8), (2, 10, 1, 7), (2, 13, 1, 7), (3, 14, 1, 9), (3, 15, 1, 5)]
    table = spark.createDataFrame(rows, "key bigint, id bigint, degree bigint, cluster bigint")
    apart = near_duplicates.still_apart(table)
    assert sorted(map(tuple, apart.collect())) == [r for r in rows if r[0] != 2]
    largest = near_duplicates.with_largest(apart)
    # Of clusters of one size the one with the greatest number.
    assert sorted((r["key"], r["id"], r["total"], *r["top"]) for r in largest.collect()) == [
        (1, 10, 3, 2, 7), (1, 11, 3, 2, 7), (1, 12, 3, 2, 7), (3, 14, 2, 1, 9), (3, 15, 2, 1, 9),
    ]
    for found in (near_duplicates.still_apart(table), near_duplicates.with_largest(table)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
