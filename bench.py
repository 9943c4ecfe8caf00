"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forkline.plans.catalog import QUERIES
from forkline.session import local_session, scratch_scope

HEADLINE = (
    "corpus_clean", "stratified_subsample", "split_members", "scorecard_by_split", "phi_structural", "phi_ambiguity",
    "compression_documents", "psi_lo", "chi", "knn_euclidean", "geometry_density", "analysis_full", "univariates",
    "univariates_lineitem", "threshold_sweep", "policy_fit", "linear_probes", "decisions", "evaluate_policies",
    "decide_stream", "hi_rate_windows",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session("bench", cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # One small job and one Python worker, so that start-up is not charged to the first query.
    spark.range(1000).mapInPandas(lambda it: it, "id long").count()
    times = {}
    for name in HEADLINE:
        with scratch_scope(spark):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
