"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS.
Every query runs from the Parquet files to its last row.
"""

from __future__ import annotations

import json
import os
import time

from meterline.queries import QUERIES
from meterline.session import local_session

HEADLINE = [
    "usage_dedup",
    "price_events",
    "reset_windows",
    "usage_window_asof",
    "usage_turn",
    "usage_facts",
    "replay_prefix",
    "resolve_root",
    "log_upsert",
    "usage_daily",
    "usage_minute",
    "usage_window",
    "usage_session",
    "report_sessions",
    "capacity_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
