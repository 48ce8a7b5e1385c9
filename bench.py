"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is run in full: its rows
go to Spark's no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuskeel.plans import RUNNERS  # noqa: E402
from corpuskeel.session import local_session, scratch_scope  # noqa: E402

HEADLINE = [
    "io1_projected_scan",
    "pf1_eligibility",
    "sf1_text_group",
    "sf8_sign_code",
    "ag3_duplicate_groups",
    "ag7_describe",
    "ag9_summary_levels",
    "ag15_grid_counts",
    "ag18_paired_bootstrap",
    "jn1_total_join",
    "jn2_reconcile",
    "jn7_near_pairs",
    "jn12_approval_check",
    "ag19_classification",
    "wn2_candidate_order",
    "wn8_shortest_prefix",
    "wn9_proposals",
    "gr3_components",
    "gr4_leakage_frame",
    "wn10_allocate",
    "st1_stream_replay",
    "im4_block_coefficients",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "corpuskeel-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, failed = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            with scratch_scope(spark):
                RUNNERS[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # a failed query must not cost the timings of the others
            failed[name] = f"{type(error).__name__}: {error}"[:300]
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "failed": failed, "sf": os.path.basename(folder.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
