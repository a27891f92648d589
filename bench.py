"""Time headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "screen_anomalies", "rolling_background", "background_composite", "candidate_pairs", "match_events", "cluster_events",
    "persist_candidates", "infra_context", "catalog_rate_lookup", "extract_blobs", "source_component", "plume_mask",
    "binary_open", "enhancement_rtm", "reference_median", "integrated_mass", "honesty_gates", "rate_monte_carlo",
    "robust_sigma", "noise_scene_join", "atlas_summary", "pair_references", "reference_pass_select", "winds_window_median",
    "cluster_bootstrap_precision", "roc_curve", "catalog_load", "scene_features", "run_detector", "align_shift",
]


def main() -> None:
    from airtrace.plans import QUERIES
    from airtrace.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str, folder: str) -> float:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        run("screen_anomalies", small)
        run("cluster_events", small)
    times = {n: round(run(n, sf_dir), 3) for n in names}
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
