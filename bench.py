"""Time the headline queries at $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from brooklog.session import local_session
from checks.queries import QUERIES

HEADLINE = (
    "page_desc", "page_by_field", "total", "distribution", "distribution_by_source", "distribution_auto_orders", "top_sources",
    "facets", "available_columns", "term", "term_any_field", "phrase", "phrase_fuzzy", "wildcard_prefix", "fuzzy", "bool_query",
    "extract_fields", "extract_first", "suggest_multi", "smart_decode", "fold_header", "detect_fold", "parse_ts",
    "carry_forward", "rollover_days", "rollover_years", "tag_counts", "run_views", "delete_ids", "skipped_while_paused",
    "ingest_rows",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    spark.read.parquet(f"{sf}/events.parquet").count()  # start-up is not part of any query
    for name in HEADLINE:
        at = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - at, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
