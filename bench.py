"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Each query is
written to a no-op sink, so every output row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import time

from gridtide.catalog import REGISTRY
from gridtide.session import local_session

HEADLINE = [
    "hourly_resample", "densify_ffill", "ffill_limit_3", "imbalance_lags", "rolling_full",
    "rolling_minperiods", "ewm_span8", "direction_streak", "periods_since_stress", "flip_rate",
    "trailing_anomaly", "calendar_features", "interval_expand", "latest_revision", "dedup_keep_last",
    "asof_run_join", "asof_row_join", "nearest_lookup", "run_history", "master_frame",
    "imbalance_feature_matrix", "spot_feature_matrix", "percentile_table", "box_stats",
    "histogram_40", "autocorrelation", "spot_metrics", "roc_auc_exact", "profit_curve",
    "threshold_sweep", "price_snapshot", "forecast_snapshot", "insert_replace", "null_report",
    "ridge_neutralise", "quantile_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gridtide-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
