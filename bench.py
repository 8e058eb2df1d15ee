"""Headline benchmark: one JSON line with seconds per query.

Every query starts from the parquet tables, panel construction included. ``pred_rolling_cv`` also pays
for the study run that the ranking queries after it share.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "panel_from_events", "train_val_test", "compute_features", "feature_catalogue", "infer_period", "decompose", "evaluate_forecasts", "fc_ets", "fc_ets_seasonal",
    "fc_arima", "bootstrap_metrics", "nearest_series", "pred_rolling_cv", "best_method", "spearman", "mann_whitney", "cluster_density", "violin_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from accuracast.plans import load_all
    from accuracast.session import build_session

    queries, _ = load_all()
    spark = build_session(cpus, "bench", spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8", spark__driver__memory="8g")
    queries["fc_meanfill"](spark, sf_dir).count()  # start the JVM and the Python workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
