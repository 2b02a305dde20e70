"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is materialised through the ``noop`` sink, so all rows and columns
are produced.  One untimed pass over a small table warms the JVM and a worker.
"""

from __future__ import annotations

import json
import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")

HEADLINE = (
    "a03_run_rows", "a02_line_subject_rows", "v09_manifest_consistency", "v10_hop_lattice", "w03_switch_count", "r02_hop_windows", "k04_fixed_arm_replay",
    "k05_rule_selector_replay", "k08_greedy_replay", "k09_beam_replay", "a04_method_summary", "j02_trajectory_compare", "a09_crossover_arms", "k07_counterfactuals",
    "g03_dominant_frequency", "g04_hop_measurements", "w04_relative_features", "b01_equal_clip_bootstrap",
)


def main() -> None:
    from windfold.plans import catalog
    from windfold.session import local_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "windfold-bench")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").mapInPandas(lambda it: it, "n_nationkey int, n_name string, n_regionkey int").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
