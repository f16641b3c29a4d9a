"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR is the input folder, BENCH_CPUS the number of local cores. Stored tables are let go of before
every query, so its time does not depend on those before it. Only the queries of MODELS share one
snapshot and the models that the train_* queries among them fit, in this order.
"""

from __future__ import annotations

import json
import os
import time

from brisa.catalog import QUERIES
from brisa.catalog.registry import forget
from brisa.session import local_session

HEADLINE = [
    "features_full",
    "incremental_features",
    "long_series_rolling",
    "correlation_matrix",
    "describe",
    "describe_wide",
    "boxplot_stats",
    "boxplot_by_month",
    "transition_matrix",
    "histogram_20",
    "gap_report",
    "alert_events",
    "dedup_upsert",
    "feature_table_append",
    "latest_row",
    "prediction_monitor",
    "stream_ingest",
    "stream_hourly_avg",
]
MODELS = [
    "train_ridge",
    "train_random_forest",
    "train_gbt",
    "permutation_importance",
    "batch_predict",
    "forecast_3_days",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, app="brisa-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["dataset_size"](spark, folder).collect()  # starts the executors
    seconds = {}
    for name in HEADLINE + MODELS:
        if name not in MODELS[1:]:
            forget()
        start = time.perf_counter()
        # The no-op sink computes every column of every row and keeps nothing.
        result = QUERIES[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    readings = spark.read.parquet(f"{folder}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "events": readings,
                "cores": cores,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
