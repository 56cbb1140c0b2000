"""Run registered queries and their SQL side by side on the driver's tables.

    python tests/compare.py 0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from storeloom.plans.fixtures import TABLES  # noqa: E402


def sf_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    return rows_of(df.columns, df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def main() -> int:
    from storeloom.plans.all_queries import REGISTRY
    from storeloom.session import build_session

    sf, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir(sf))
    bad = 0
    for name in names:
        q = REGISTRY[name]
        start = time.time()
        try:
            got = spark_rows(q.run(spark, sf_dir(sf)))
            took = time.time() - start
            n = sum(got[1].values())
            if q.oracle is None:
                print(f"rows {name:28s} {n:7d} rows {took:6.2f}s")
                continue
            want = sql_rows(con, q.oracle)
            if got == want:
                print(f"ok   {name:28s} {n:7d} rows {took:6.2f}s")
                continue
            bad += 1
            print(f"DIFF {name}: {got[0]} {n} rows, want {want[0]} {sum(want[1].values())} rows")
            print("   only spark:", list((got[1] - want[1]).items())[:3])
            print("   only sql:  ", list((want[1] - got[1]).items())[:3])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:600]}")
        sys.stdout.flush()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
