"""Times the registered queries; prints one JSON line.

BENCH_SF_DIR   tables to read   (default /root/testdata/sf0.1)
BENCH_CPUS     local cores      (default 8)
BENCH_RUNS     timed runs each, after one warm-up (default 3; the median counts)
BENCH_BUDGET   seconds after which the remaining queries get one timed run (default 420)
BENCH_QUERIES  comma-separated names (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from storeloom.plans.all_queries import REGISTRY
from storeloom.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(REGISTRY)
    spark = build_session(
        "storeloom-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    budget = float(os.environ.get("BENCH_BUDGET", "420"))
    began = time.perf_counter()
    took, failed, once_only = {}, {}, []
    for name in names:
        try:
            once(name)
            left = runs if time.perf_counter() - began < budget else 1
            took[name] = round(statistics.median(once(name) for _ in range(left)), 4)
            if left < runs:
                once_only.append(name)
        except Exception as e:  # noqa: BLE001  (one broken query must not hide the others)
            failed[name] = str(e)[:200]
        print(f"{name}: {took.get(name, 'failed')}", file=sys.stderr)
    line = {
        "metric": "total of median query times",
        "value": round(sum(took.values()), 4),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if once_only:
        line["one_run_only"] = once_only
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
