"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tributary import catalogue  # noqa: E402
from tributary.plans import exports  # noqa: E402
from tributary.session import local_session  # noqa: E402

HEADLINE = [
    "union_sources", "file_profile", "decide_mapping", "accept_adjudication", "infer_date_order", "link_entities",
    "merge_first_non_blank", "value_conflicts", "clean_record", "change_log", "validate_records", "fuzzy_lookup_topk",
    "golden_records", "build_escalations", "replay_overrides", "dedupe_open", "auto_close_stale", "push_valid",
    "retry_failed", "upsert_target", "rollback", "run_stats", "escalation_subject",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    catalogue.load()
    exports.raw_exports(spark, sf_dir)  # the input files of the runs
    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
