"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cirro.plans.queries import QUERIES

HEADLINE = [
    "flagship", "aggregate_hourly", "aggregate_daily_local", "qc_step", "qc_persistence", "qc_climatology", "qc_spatial_mad", "qc_solar", "consistency_enforce",
    "fill_linear", "fill_circular", "fill_tier", "supersede_merge", "as_of_read", "forecast_dedup", "history_daily_composite", "latest_issuance", "verification_pairs",
    "mae_rmse", "baseline_climatology", "fit_qmap", "apply_qmap", "emos_fit", "mean_bias_fit", "rank_histogram", "spread_error_ratio", "rolling_origin_mean_bias", "nearest_stations",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["flagship"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms the session up
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
