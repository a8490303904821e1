"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set below, 'all' for every query).
Each query is forced to completion with the no-op sink (nothing is collected).
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qualis.catalog import QUERIES  # noqa: E402
from qualis.session import build_session  # noqa: E402

HEADLINE = [
    "profile_completeness", "profile_distinct", "profile_numeric", "profile_outliers", "profile_histogram",
    "profile_top_values", "profile_duplicates", "profile_time", "profile_monotonic", "profile_strings",
    "profile_patterns", "pii_scan", "column_roles", "issues", "remediate_all", "remediation_log", "mask_all",
    "global_mask", "grain_scores", "grain_check", "wide_orders", "wide_rejoin", "chart_bar", "chart_summary",
    "flags", "canonical_categories", "rare_to_other", "dedupe_aggregate", "safe_casts", "normalize_text",
    "free_text_pii", "policy_decisions", "dataset_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else ([w for w in wanted.split(",") if w] or HEADLINE)
    spark = build_session(cpus=cpus, app="qualis-bench")
    # warm-up: JVM start, codegen caches
    QUERIES["chart_pie"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
        gc.collect()  # drop Python-side handles so the JVM can free plans and shuffle state
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}))


if __name__ == "__main__":
    main()
