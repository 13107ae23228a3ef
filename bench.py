"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each time covers building the query and computing every row of the result. All queries run once before they are timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from airlog.session import local_session  # noqa: E402
from queries import load  # noqa: E402

HEADLINE = (
    "coverage", "coverage_by_user", "coverage_spans", "overlap_components", "overlap_join_keyed", "overlap_join_bucketed",
    "exclude_overlapping", "now_playing", "slot_grid", "lookahead", "diff_schedules", "new_findings", "history_differences",
    "fingerprint", "diff_snapshots", "cache_delta", "reconcile_ids", "plan_timeline", "segments", "thin_segments",
    "assemble_plan", "assign_episodes", "least_played", "apply_plays", "meta_hint_pool", "parse_title", "parse_sidecars",
    "hint_matches", "slot_calendar", "check_guide", "check_plans", "replay_counts", "recommend",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = load().QUERIES, {}
    for timed in (False, True):
        for name in HEADLINE:
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
