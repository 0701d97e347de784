"""Time the headline queries: one discarded run, then one timed run each.

Prints one JSON line.  Rows go to the noop sink, so only the plan is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from grantmill.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    "ratio_rollup", "ratio_scenario_compare", "leave_one_out", "category_distribution", "top_funders", "dedupe_collect_phrases",
    "id_collision_rename", "dedupe_title", "match_pairs", "term_stats", "rule_labels", "ambiguous_by_rule", "keyword_drivers",
    "census_summary", "multiclass_prf", "latest_judgments", "fleiss_kappa", "cohen_kappa_pairs", "contention_consensus", "hash_split",
    "quota_sample", "gate_summary_wilson", "candidate_lift", "quote_verification", "validation_report", "country_index", "table_digest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    timings = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
