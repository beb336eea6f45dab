"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Each query runs once
to warm up, then BENCH_RUNS times (default 1); the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfcast.catalog import QUERIES  # noqa: E402
from shelfcast.catalog.model_queries import QUERY_ROUNDS  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

HEADLINE = (
    "create_features",
    "reorder_recommendations",
    "bulk_recommend",
    "recommend",
    "all_metrics",
    "valid_metrics_mase_pooled",
    "metrics_by_store",
    "error_percentiles",
    "error_percentiles_by_store",
    "resample_week",
    "resample_month",
    "dashboard_kpis",
    "upsert_keep_last",
    "encode",
    "inventory_view",
    "check_foreign_keys",
    "store_model_training",
    "global_model_report",
)


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "shelfcast-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": Path(tempfile.mkdtemp(prefix="bench-checkpoints-")).as_uri(),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(min(run(spark, name, sf_dir) for _ in range(runs)), 3)
        spark.catalog.clearCache()
        print(f"{name}: cold {cold[name]} s, warm {warm[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "global_model_rounds": QUERY_ROUNDS,
            }
        )
    )


if __name__ == "__main__":
    main()
