from datetime import datetime, timedelta

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from storeloom.session import work_folder
from storeloom.streaming.id_log import IdLog

T0 = datetime(2024, 3, 1)
SCHEMA = "id LONG, at TIMESTAMP, body STRING"


def weeks(batches, size, seed):
    """New ids day by day, some of them repeats from any day before; rows without id or time."""
    rng = np.random.default_rng(seed)
    given, made = [], 0
    for day in range(batches):
        batch = []
        for i in range(size):
            again = made and rng.random() < 0.2
            key = int(rng.integers(made)) if again else made
            made += not again
            at = None if rng.random() < 0.05 else T0 + timedelta(days=day, seconds=i)
            batch.append((key, at, f"{day}-{i}"))
        batch += [(None, T0 + timedelta(days=day), "no id"), (None, None, "neither")]
        given.append(batch)
    return given


def plain(given):
    """First batch, then first time (none first), of every id."""
    seen, kept = set(), []
    for n, batch in enumerate(given):
        firsts = {}
        for key, at, body in batch:
            if key is None:
                kept.append((key, at, body, n))
            elif key not in seen:
                rank = (at is not None, at or T0, body)
                firsts[key] = min(firsts.get(key, (rank, at, body)), (rank, at, body), key=lambda x: x[0])
        seen |= set(firsts)
        kept += [(k, at, body, n) for k, (_, at, body) in firsts.items()]
    return kept


def run(spark, given, **rules):
    frames = [spark.createDataFrame(b, SCHEMA) for b in given]
    log = IdLog(work_folder(spark, "id_log"), frames[0].schema, "id", "at", ("body",), **rules)
    for n, frame in enumerate(frames):
        log.step(frame, n)
    return log, frames


def in_order(found):
    return sorted(found, key=lambda r: tuple((v is None, v) for v in r))


def test_weeks_of_ids_are_exact_and_look_ups_stay_few(spark):
    given = weeks(9, 400, 1)
    log, frames = run(spark, given, words=4096, merge_every=3)
    wanted = in_order(plain(given))
    assert rows(log.kept(spark)) == wanted
    looks = log.looks(spark).orderBy("batch_id").collect()
    for x in looks[1:]:
        assert x["n_seen"] > 0
        assert x["n_hits"] - x["n_seen"] < 0.05 * x["n_ids"]
    # Both a batch in the middle of a set and one that writes a set can be repeated.
    for n in (7, 6):
        log.step(frames[n], n)
    assert rows(log.kept(spark)) == wanted


def test_a_filter_that_lets_all_through_changes_nothing(spark):
    given = weeks(3, 200, 2)
    log, _ = run(spark, given, words=1)
    assert rows(log.kept(spark)) == in_order(plain(given))


def test_one_id_in_every_row_and_empty_batches(spark):
    given = [[(7, T0 + timedelta(seconds=n), "x")] * 300 for n in range(3)]
    given.insert(1, [])
    log, frames = run(spark, given, merge_every=2)
    assert rows(log.kept(spark)) == [(7, T0, "x", 0)]
    empty, _ = run(spark, [[], [], []], merge_every=2)
    assert empty.kept(spark).count() == 0


def test_no_state_in_spark(spark):
    """All that the stream remembers lies in its own files."""
    folder = work_folder(spark, "drops")
    for n in range(2):
        rows_ = spark.range(50).select(
            "id", (F.lit(T0) + F.make_dt_interval(days=F.lit(n))).alias("at"), F.lit("b").alias("body")
        )
        rows_.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    log = IdLog(work_folder(spark, "id_log"), stream.schema, "id", "at")
    query = log.start(stream)
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    assert log.kept(spark).groupBy("batch_id").count().collect() == [(0, 50)]
