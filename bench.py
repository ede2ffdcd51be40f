"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (default 1, the median counts). The derived archive is
written before the clock starts; the flow queries make all their intermediate tables anew in every run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

HEADLINE = [
    "page_addresses", "page_anchors", "page_link_targets", "page_scripts", "normalized_documents", "decoded_pages", "job_link_rule",
    "greenhouse_jobs", "lever_jobs", "ashby_jobs", "linked_data_jobs", "embedded_jobs", "page_job_links", "hub_ranking",
    "first_wins_merge", "listing_records", "all_records", "records_with_rendered_fallback", "rendered_records", "missing_captures",
    "streamed_postings", "streamed_first_postings", "merged_shard_files",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))

    from checks.queries import QUERIES, archive, forget_runs
    from vacantia.session import local_session

    spark = local_session(cpus, shuffle_partitions=cpus)
    archive(spark, sf)
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            forget_runs()
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {"metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}
        )
    )


if __name__ == "__main__":
    main()
