"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores; BENCH_ALL=1 times
every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkdesk.registry import registered  # noqa: E402
from sparkdesk.session import build_session  # noqa: E402

HEADLINE = [
    "monthly_ledger_a1", "provider_tally_a2", "all_time_rollup_a3", "usage_summary_a4", "provider_breakdown_a5",
    "price_as_of_j3", "clean_reply_p1", "token_estimate_p7", "artifacts_w1", "artifact_index_w2", "context_plan_w7",
    "deduplicated_calls_w23", "chat_search_k15", "transcripts_a19", "page_categories_k1", "uncertain_pages_k2",
    "category_counts_a8", "assembled_documents_a15", "failure_runs_w9", "page_pictures_w11", "decoded_replies_t1",
    "assembled_replies_t2", "check_rows_k8", "run_summary_a11", "endpoint_report_k10", "disallowed_markup_k13",
    "readable_pages_k14", "markdown_blocks_w13", "slides_w16", "package_problems_j9", "reading_order_w12",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "sparkdesk-bench", partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    queries[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    times = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
