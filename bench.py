"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
8), BENCH_QUERIES (comma-separated names). One warm-up and BENCH_RUNS (default
2) timed runs each; the fastest counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "panel_rows",
    "universe_top_by_cap",
    "average_daily_value",
    "benchmark_weights",
    "benchmark_return",
    "forward_returns",
    "impact_cost",
    "risk_exposures",
    "factor_risk_decomposition",
    "rank_ic_and_spread",
    "calibration_signals",
    "optimal_weights",
    "constraint_audit",
    "drift_nav",
    "performance_metrics",
)


def timed(spark, fn, sf_dir: str) -> float:
    from tidefolio.session import release

    start = time.time()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.time() - start
    release(spark)  # the tables of the query's own steps
    return took


def main() -> None:
    from tidefolio.catalog import queries
    from tidefolio.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known, took = queries(), {}
    for name in names:
        timed(spark, known[name], sf_dir)
        took[name] = round(min(timed(spark, known[name], sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
