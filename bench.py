"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spoorline.plans import (  # noqa: E402, F401  (importing registers the queries)
    catalog_field,
    catalog_images,
    catalog_scores,
    catalog_sets,
    catalog_streams,
)
from spoorline.plans.registry import QUERIES  # noqa: E402
from spoorline.session import local_session  # noqa: E402

HEADLINES = [
    "evaluate_retrieval",
    "near_duplicate_pairs",
    "leakage_groups",
    "burst_pairs",
    "build_split",
    "encounters_with_place",
    "attach_quota",
    "upload_verdict",
    "validate_media",
    "true_rank",
    "open_set_metrics",
    "calibrate_threshold",
    "replay_encounters",
    "exact_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        timed = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:  # the first run warms up
                timed.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timed), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
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
