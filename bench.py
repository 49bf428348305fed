"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores.  The stored
tables the queries start from (telemetry, executor pairs) are derived first and
timed as a query of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowscope.plans.bridge import Bridge  # noqa: E402
from flowscope.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "executor_traffic",
    "inter_node_traffic",
    "slot_traffic",
    "node_traffic",
    "top_executor_pairs",
    "rank_executor_traffic",
    "affinity",
    "score_moves",
    "best_pair_placement",
    "reschedule_decision",
    "tuple_counts",
    "counter_delta",
    "moving_rate",
    "assignment_changes",
    "cooldown_alerts",
    "stream_tuple_counts",
]


def derive(bridge: Bridge) -> None:
    bridge.load.count()
    bridge.pairs.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowscope-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    timed("derive_telemetry", lambda: derive(Bridge(spark, sf_dir)))
    for name in sys.argv[1:] or HEADLINE:
        df_of = QUERIES[name]
        timed(name, lambda: df_of(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
