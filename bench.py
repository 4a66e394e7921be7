"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalogue import QUERIES  # noqa: E402
from starloom.session import local_session  # noqa: E402

HEADLINE = [
    "label_counts",
    "best_match",
    "match_statistics",
    "record_coverage",
    "population_summary",
    "null_profile",
    "binned_error_rates",
    "rule_violations",
    "histogram_density",
    "box_plot_events",
    "exact_quantiles_price",
    "violin_log_values",
    "density_grid",
    "outside_contour",
    "distribution_curve",
    "classifier_metrics",
    "pr_roc_curves",
    "stratified_label_split",
    "cross_population_split",
    "periodic_neighbours",
    "forward_fill_turns",
    "two_level_text_scan",
    "feature_importance",
    "importance_by_split",
    "model_logistic",
    "sampled_contributions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    QUERIES["population_counts"](spark, sf).collect()  # warm-up: JVM, code generation, file listing
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
