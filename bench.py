"""Time the headline queries: one JSON line with seconds per query (median of the runs after a warm-up)."""

import json
import os
import statistics
import time

from harborline.plans.catalog import QUERIES
from harborline.session import build_session

HEADLINE = [
    "job_operations_overview", "job_feature_tables", "job_seller_dataset", "job_daily_report",
    "stock_health_sql", "supplier_tier_sql", "stockout_timeline_sql", "risk_ranking_sql", "reorder_supplier_sql",
    "demand_features", "demand_spike", "forecast_features_nb", "supplier_performance", "supplier_risk_score",
    "master_build", "seller_window_aggs", "trend_slopes", "churn_labels", "dispatch_percentiles",
    "scenario_whatif", "sales_model", "anomaly_ecod", "corr_matrix", "dq_report", "vector_topk", "stream_metrics",
]
# Fits take a while and are timed once.
ONCE = {"sales_model"}
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 if name in ONCE else RUNS + 1):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({
        "metric": "headline queries, warm median", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
