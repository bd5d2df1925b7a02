"""Wall seconds of the headline queries; prints one JSON line.

    BENCH_SF_DIR   tables to read          (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads           (default 8)
    BENCH_RUNS     timed runs per query    (default 3, the median counts)
    BENCH_ALL=1    every registered query instead of the headline ones
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pulsegrid.plans.registry import QUERIES  # noqa: E402
from pulsegrid.session import build_session  # noqa: E402

HEADLINE = [
    "dau", "overview_kpis", "user_activity", "concurrent_users", "wau_mau", "platform_kpis", "events_by_hour",
    "activity_heatmap", "time_spent_leaderboard", "cohort_retention", "funnel_notification_trade", "feature_engagement",
    "trade_kpis", "daily_trades", "top_traders_by_volume", "perps_volume_by_asset", "recent_perps", "leverage_histogram",
    "platform_perps_kpis", "wallet_identity", "notification_kpis", "time_to_trade", "time_to_trade_stats",
    "metric_series", "api_health", "service_health", "venue_health", "errors_by_service", "top_error_messages",
    "swap_http_errors", "stream_concurrent_users",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):  # the first run warms up
            begun = time.perf_counter()
            QUERIES[name].frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total wall time of the queries (median of runs, warm)", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(found.group(1)) if found else None}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
