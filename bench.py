"""Benchmark the headline queries.

Runs each query end to end into Spark's ``noop`` sink (full execution, nothing
collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one JSON
line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "load_attendance",        # text parse + null tokens + first-wins dedup
    "load_grades",            # column mapping, generated ids (distributed rank), parse, range filter, dedup
    "attendance_metrics",     # counts + skew-safe ordered trend
    "grade_metrics",          # weighted mean, std, trend
    "student_analysis",       # flagship: both sides, full outer join, levels, course
    "course_metrics",
    "summary",
    "report_at_risk",
    "competency_metrics",
    "threshold_what_if",
    "ml_kmeans",              # K-Means, 10 restarts
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from tutorlens.plans.registry import REGISTRY
    from tutorlens.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus, app_name="tutorlens-bench")
    # warm-up: JIT and file listing, not timed
    REGISTRY["attendance_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
