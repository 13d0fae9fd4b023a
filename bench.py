"""Seconds per headline query. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES may name other registered queries, separated by commas.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from convsignals.plans.catalog import all_queries  # noqa: E402
from convsignals.session import local_session  # noqa: E402

HEADLINE = [
    "session_outcome_summary",
    "message_sessions",
    "prefix_text",
    "prefix_behavior_features",
    "behavior_features_text",
    "document_signals",
    "clean_text_phones",
    "normalize_text",
    "feature_statistics",
    "stratified_split",
    "metrics_by_fraction",
    "model_comparison_summary",
    "length_percentiles",
    "turn_violations",
    "nested_violations",
    "exact_duplicates",
    "tfidf_weights",
    "similar_conversations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    registered = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
