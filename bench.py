"""Headline timings: one JSON line on stdout.

Every query runs end to end from the parquet tables to a no-op sink that forces all columns of all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from demandloom.plans import load_catalog

HEADLINE = (
    "integrate_daily_panel", "dq_suite", "dq_panel_invariants", "weekly_panel", "panel_fill", "sku_demand_profile", "temporal_patterns",
    "demand_distribution", "asof_snapshot_to_week", "feature_table", "baseline_forecasts", "evaluate_forecasts", "select_architecture",
    "risk_scores", "recommendations", "production_run", "overstock_threshold_sweep", "model_linear",
    "valuation_hypotheses", "inventory_field_audit",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        # The tables are small next to the window work on them, so keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "256k")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    catalog["weekly_panel"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
