"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS``
(default 8).  Each query is built and run to the no-op sink, warm, so every row is
computed and nothing is kept between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from laneflow.catalog import QUERIES  # noqa: E402
from laneflow.catalog.fixtures import Fixtures  # noqa: E402
from laneflow.catalog.q_models import TARGET, training_and_test  # noqa: E402
from laneflow.models.estimators import model_grid  # noqa: E402
from laneflow.models.evaluation import evaluate_regression  # noqa: E402
from laneflow.session import build_session  # noqa: E402

HEADLINE = [
    "a01_bin_readings", "a02_hourly_stats", "a05_monthly_stats", "a09_group_speed_summary", "a12_daily_active_counts",
    "a27_week_profile_pivot", "j01_nearest_segment_join", "j02_interval_overlap_counts", "j04_densify_grid",
    "j10_date_spine_range_join", "w01_add_lags_sparse", "w02_interpolate_linear", "w05_sliding_sequences",
    "t03_priority_sort_limit", "u02_union_sources", "r01_poll_counts", "e1_feature_table", "m01_balance_by_event",
    "m25_lagged_correlation", "m30_per_segment_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
    })

    def run(name: str) -> float:
        begin = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.monotonic() - begin

    def fit_seconds() -> dict[str, float]:
        train, test = training_and_test(Fixtures(spark, sf_dir))
        models = model_grid("lr", n_rows=train.count())
        return {n: round(evaluate_regression(models[n], train, test, TARGET)["fit_time"], 3) for n in ("lr_base", "lr_full", "ridge_full", "lasso_full")}

    run("a09_group_speed_summary")
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "fit_seconds": fit_seconds(),
    }))


if __name__ == "__main__":
    main()
