"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from rankmill.catalog import QUERIES
from rankmill.session import build_session

HEADLINE = [
    "class_report",
    "population_cube",
    "distinct_on_key",
    "upsert_latest",
    "upsert_event_time",
    "bottom_per_server",
    "stale_not_in",
    "server_populations",
    "refresh_plan",
    "character_answer",
    "pivot_rank_types",
    "split_valid_rows",
    "extract_list_items",
    "ingest_pages",
    "open_request_within_5min",
    "enqueue_dedup",
    "request_maintenance",
    "fail_or_retry",
    "list_fingerprint",
    "fingerprint_changed",
    "extract_article",
    "ops_dashboard",
    "stream_upsert",
    "stream_hourly_volume",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("scan_pages", "bottom_rank_ties"):  # start-up of JVM and scans is not part of any query
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
