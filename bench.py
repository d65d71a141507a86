"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line on stdout."""
from __future__ import annotations

import json
import os
import time

from sparkpanel.catalog import REGISTRY
from sparkpanel.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "daily_bars", "master_calendar", "overnight_target", "embargoed_splits", "rolling_mean_std", "rolling_median",
    "rolling_pct_rank", "ewm_magnitude", "sign_streak", "five_minute_bars", "session_features", "market_lags",
    "cs_rank", "cs_zscore", "feature_panel", "monthly_stability", "direction_metrics", "rank_ic_daily",
    "decile_gradient", "statistics_table", "economic_robustness", "bootstrap_direction", "bootstrap_table",
    "ecdf_confidence", "prob_up", "ridge_two_features", "dataset_fingerprint",
]


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "8")))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
