"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3): after one warm-up the median of the runs counts.
Every row of a result is computed and discarded by the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewell.plans import devices, experiments  # noqa: E402
from tidewell.plans.catalogue import QUERIES  # noqa: E402
from tidewell.session import build_session  # noqa: E402

# Reference indexes, built anew on each run.
BUILDS = {
    "geo_index_build": devices.build_index,
    "experiment_index_build": experiments.build_index,
}

HEADLINE = [
    "geo_index_build",
    "experiment_index_build",
    "ip_location_enrich",
    "registrations_by_state",
    "user_agent_enrich",
    "device_event",
    "device_profile_state",
    "device_profile",
    "registration_metrics",
    "request_submit",
    "request_submit_answer",
    "request_status",
    "request_read_answer",
    "request_list",
    "request_search",
    "schema_rules",
    "role_authorize",
    "channel_exhaust_files",
    "public_exhaust_files",
    "dataset_upsert",
    "report_apply_changes",
    "report_read",
    "experiment_read",
    "experiment_match",
    "experiment_match_repeated",
    "experiment_assign",
    "modulus_bucket",
    "experiment_upsert",
    "client_log_validate",
    "exhaust_extract",
    "exhaust_stats",
    "report_spec_run",
    "usage_summary",
    "usage_sketch_rollup",
    "device_registration_stream",
    "experiment_assign_stream",
    "experiment_match_small_weight",
    "request_registry_upsert",
    "request_search_laid_out",
    "usage_fact",
    "usage_returning",
    "exhaust_observed",
    "dataset_asked_files",
    "device_event_log",
    "registration_metrics_stream",
    "published_windows_stream",
    "versioned_location_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        if name in BUILDS:
            BUILDS[name](spark, sf_dir)
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
