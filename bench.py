"""Bench: headline catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and run to completion through the ``noop`` sink (full
execution, nothing collected).  Prints one JSON line.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codesim.plans import catalogue  # noqa: E402
from codesim.session import local_session  # noqa: E402

HEADLINE = [
    "suspicious_pairs",
    "suspicious_pairs_pruned",
    "flagged_files_top20",
    "cross_path_flagged_pruned",
    "all_file_similarities",
    "overall_similarity",
    "term_counts",
    "line_overlap",
    "submission_overview",
    "run_summary",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="codesim-bench-")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, scratch=scratch)
    # warm-up on the smaller scales (not timed): JVM JIT, codegen caches
    for small in ("sf0.001", "sf0.01"):
        warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), small)
        if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
            catalogue.suspicious_pairs(spark, warm).write.format("noop").mode("overwrite").save()
    catalogue.files_admitted(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
