"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.catalog.all import REGISTRY  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINE = [
    "size_outliers",
    "bus_factor",
    "categorize",
    "fingerprint",
    "pattern_scan",
    "co_change",
    "hidden_only",
    "ripple_groups",
    "candidate_pairs",
    "longest_common_run",
    "duplicate_scores",
    "projection_similarity",
    "nearest_preceding",
    "usage",
    "resolve_path",
    "longest_prefix_map",
    "ground_quotes",
    "recall",
    "absence",
    "followups",
    "drift",
    "clusters",
    "validate_records",
    "instability",
    "cohesion",
    "cycles",
    "conformance",
    "running_section",
    "top_per_group",
    "confusion",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "plumbline-bench")
    # Start the engine and the readers once, outside the timings.
    spark.read.parquet(f"{folder}/region.parquet").count()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
