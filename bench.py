"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from terrace.plans.catalog import all_queries
from terrace.session import local_session

HEADLINE = [
    "parse_normalize_text", "parse_places", "dedup_exact", "repeat_levels", "components_compose", "filter_group_minimum",
    "eda_state_type_median", "eda_describe", "agg_missingness_by_group", "agg_ecdf", "fold_balanced", "encode_target_oof",
    "eval_regression_metrics", "eval_tail_segments", "geo_radius_counts",
    # Since round 2.
    "quality_validity_audit", "model_oof_ridge", "model_oof_boosting", "text_tfidf", "encode_micro_market_oof", "geo_nearest",
    "eval_bootstrap_intervals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "8g"))
    queries = all_queries()
    seconds = {}
    # One small query first, so that JVM start-up is not charged to a headline.
    queries["agg_pearson"](spark, folder).collect()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
