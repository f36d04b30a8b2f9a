"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS name the tables and the number of cores. Every
query is run to the end into a sink that throws rows away; the second of two
runs counts, so JVM start-up does not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from temblor import registered  # noqa: E402
from temblor.session import build_session  # noqa: E402

HEADLINE = [
    "clean_table", "region_share", "region_profile", "numeric_summary", "daily_features", "historical_30d",
    "parent_link", "sequence_stats", "shock_roles", "aftershock_flag", "since_last_m5", "stress_proxy", "b_value",
    "outliers", "frequent_itemsets", "lookback_matrix", "corr_spearman", "auc", "event_clusters",
    # The same work by the plans for large inputs.
    "interval_lags_scale", "aftershock_flag_days_scale", "historical_30d_scale", "parent_link_scale",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    spark = build_session(cores, "bench", partitions=cores)
    registered.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
