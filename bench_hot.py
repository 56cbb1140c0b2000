"""Times the operators that order rows inside a key, on a key with a third of all rows.

The rows are those of ``lineitem``, each taken often enough to reach BENCH_HOT_ROWS; a third
of them get one key, the others their part.  Prints one JSON line with seconds per operator.

BENCH_SF_DIR    tables to read   (default /root/testdata/sf0.1)
BENCH_CPUS      local cores      (default 8)
BENCH_HOT_ROWS  rows             (default 20,000,000)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from storeloom.functions.clock import minutes
from storeloom.operators import crm, dedup, outbox, rates
from storeloom.plans.fixtures import table
from storeloom.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = int(os.environ.get("BENCH_HOT_ROWS", "20000000"))
    spark = build_session(
        "storeloom-bench-hot",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag"
    )
    times = max(1, wanted // items.count())
    copies = items.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    spread = F.xxhash64("l_orderkey", "l_linenumber", "copy")
    rows = copies.select(
        spread.alias("id"),
        F.when(F.pmod(spread, F.lit(3)) == 0, F.lit(-1)).otherwise(F.col("l_partkey")).alias("k"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.pmod(spread, F.lit(86400)))).alias("ts"),
        F.col("l_returnflag").alias("s"),
    )
    minute = minutes(rows, "ts")
    jobs = {
        "dedup_ttl": lambda: dedup.dedup_ttl(rows, "k", "ts", "id", 300),
        "rate_rolling_all": lambda: rates.rate_rolling(rows, "ts", 3600, 20),
        "rate_rolling_per_key": lambda: rates.rate_rolling(rows, "ts", 3600, 20, "k"),
        "drain_plan": lambda: outbox.drain_plan(rows, "k", ["ts", "id"], minute, 5),
        "status_transitions": lambda: crm.transitions(rows, "k", "s", ["ts", "id"], minute),
    }
    took = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 2)
    print(json.dumps({"rows": items.count() * times, "unit": "sec", "operators": took}))
    spark.stop()


if __name__ == "__main__":
    main()
