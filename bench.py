"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and
the local cores.  Each query is built and fully evaluated into a sink that discards rows;
the first run of a small query warms the session up and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from canvass.catalog.queries import REGISTRY
from canvass.session import local_session

HEADLINE = (
    "describe", "validate_violations", "encode_features", "stratified_split", "stratified_folds",
    "auc_continuous", "metrics_bundle", "binomial_test", "score_fixed_tree", "score_fixed_tree_walk",
    "scoring_job", "tree_gini", "tree_entropy", "grid_search", "holdout_evaluation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "canvass-bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("table_shape")
    seconds = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
