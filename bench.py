"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Each query is planned and fully executed (results written to a no-op sink, so
every row is computed); the time includes planning and the size-check jobs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil.plans import QUERIES, load_all  # noqa: E402
from vigil.session import local_session  # noqa: E402

HEADLINE = [
    "drift_analyze", "feature_drift", "segment_drift", "period_drift", "windowed_drift", "severity_events",
    "numeric_profile", "roc_auc", "threshold_for_recall", "metrics_by_split", "stratified_split",
    "investigation_state", "job_state", "replay_summary", "promotion_decide", "event_insert_if_absent",
    "registry_upsert", "triage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(cpus, app="vigil-bench")
    times = {}
    # warm the JVM (class loading, JIT, codegen caches) once on the smoke tables; not timed
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("class_distribution", "drift_analyze"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
