from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeloom.operators.claims import ClaimTable
from storeloom.session import work_folder

T0 = datetime(2024, 1, 1)


def at(hours):
    return F.lit(T0 + timedelta(hours=hours)).cast("timestamp_ntz")


def queue(spark, n=40):
    rows = [(i, T0 - timedelta(minutes=100 - i), "pendente" if i % 5 else "enviado") for i in range(n)]
    return spark.createDataFrame(rows, "id long, due timestamp_ntz, status string")


def claimed(table, q, run, hours, **k):
    held = table.run(q, run, at(hours), 2, 4, "due", "status", "pendente", **k)
    return {r["id"]: r.attempt for r in held.collect()}


def test_overlapping_runs_share_nothing_and_expired_claims_return(spark):
    table = ClaimTable(work_folder(spark, "claims"), "id", T.LongType(), 3600)
    q = queue(spark)
    first = claimed(table, q, 0, 0)
    second = claimed(table, q, 1, 0.5)
    assert len(first) == len(second) == 8 and not first.keys() & second.keys()
    assert all(i % 5 for i in first) and set(first.values()) == {1}
    # An hour later the first run's messages are free again, the second's are not.
    third = claimed(table, q, 2, 1)
    assert third == {i: 2 for i in first}
    # What was sent does not come back; attempts are limited.
    sent = spark.createDataFrame([(i,) for i in list(second)[:3]], "id long")
    fourth = claimed(table, q, 3, 5, done=sent, max_attempts=2)
    assert set(second) - {r["id"] for r in sent.collect()} <= set(fourth)
    assert not fourth.keys() & first.keys()


def test_runs_at_the_same_time_and_a_repeated_run(spark):
    table = ClaimTable(work_folder(spark, "claims"), "id", T.LongType(), 3600)
    q = queue(spark)
    # Run 1 has not seen the claims of run 0, as it started together with it.
    other = ClaimTable(work_folder(spark, "claims"), "id", T.LongType(), 3600)
    claimed(other, q, 1, 0)
    own = claimed(table, q, 0, 0)
    other.claims(spark).drop("run").write.parquet(f"{table.root}/claims/run=1")
    assert {r["id"] for r in table.held(spark, 0).collect()} == own.keys()
    assert table.held(spark, 1).count() == 0
    assert claimed(table, q, 0, 0) == own


def test_empty_queue(spark):
    table = ClaimTable(work_folder(spark, "claims"), "id", T.LongType(), 60)
    assert claimed(table, queue(spark, 0), 0, 0) == {}
