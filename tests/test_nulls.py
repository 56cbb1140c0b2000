"""Rows with nulls where the order, the key or the time should be."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from storeloom.functions.clock import minutes
from storeloom.operators import crm, dedup, outbox, rates, search, stock
from storeloom.operators.knn_join import knn_join

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    """One busy key and some quiet ones; ties in time, and times that are null."""
    random.seed(5)
    data = [
        (
            i,
            random.choice(["hot"] * 6 + ["a", "b"]),
            None if random.random() < 0.1 else T0 + timedelta(seconds=10 * random.randint(0, 300)),
            random.choice("xyz"),
        )
        for i in range(400)
    ]
    return spark.createDataFrame(data, "id BIGINT, k STRING, ts TIMESTAMP_NTZ, s STRING").cache()


def test_drain_plan_keeps_requests_without_a_time(events):
    def plan(hot_rows):
        return rows(outbox.drain_plan(events, "k", ["ts", "id"], minutes(events, "ts"), 7, hot_rows))

    cold = plan(10**6)
    assert len(cold) == 400
    assert plan(1) == plan(30) == cold


def test_transitions_count_events_without_a_time(events):
    def count(hot_rows):
        return rows(crm.transitions(events, "k", "s", ["ts", "id"], minutes(events, "ts"), hot_rows))

    cold = count(10**6)
    assert sum(n for *_, n in cold) == 400 - events.select("k").distinct().count()
    assert count(1) == count(30) == cold


def test_compact_counts_turns_without_a_number(spark):
    random.seed(6)
    data = [("c", None if i % 9 == 0 else i, "user", "x" * random.randint(1, 9)) for i in range(60)]
    turns = spark.createDataFrame(data, "c STRING, turn INT, role STRING, text STRING")

    def used(hot_rows):
        # Turns without a number are ties, so only their total is fixed.
        got = search.compact(turns, "c", "turn", "role", "text", 50, turns_per_bucket=4, hot_rows=hot_rows)
        found = [(r.turn, r.used) for r in got.collect()]
        return sorted(x for x in found if x[0] is not None), max(u for t, u in found if t is None)

    assert used(0) == used(10**6)


def test_purchase_pages_with_items_that_are_null(spark):
    low = spark.createDataFrame(
        [("s", None if i % 50 == 0 else i, 1) for i in range(100)], "sup STRING, item INT, deficit INT"
    )
    bucket = F.floor(F.col("item") / 10)

    def pages(hot_rows):
        got = stock.purchase_report(low, "sup", "item", bucket, 30, hot_rows).collect()
        return sorted((r.page, r["items"], r.n_items) for r in got)

    assert pages(0) == pages(10**6)


def test_first_by_key_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 1), (3, 2)], "k INT, ts INT")
    assert rows(dedup.first_by_key(df, ["k"], ["ts"])) == [(3, 1), (None, 1), (None, 2)]


def test_requests_without_a_time_are_counted(spark):
    df = spark.createDataFrame([("a", T0), ("a", None)], "shop STRING, ts TIMESTAMP_NTZ")
    got = rates.rate_tumbling(df, "ts", [rates.Level("shop", "shop", 1, 633)])
    assert sorted((r.window_start is None, r.requests) for r in got.collect()) == [(False, 1), (True, 1)]


def test_quiet_weeks_have_a_position(spark):
    moves = spark.createDataFrame(
        [(1, datetime(2024, 1, 2), 5), (1, datetime(2024, 1, 30), -1), (2, datetime(2024, 1, 9), 3)],
        "item INT, ts TIMESTAMP_NTZ, q INT",
    )
    got = rows(stock.weekly_position(moves, "item", "ts", "q"))
    assert [(r[0], r[2], r[4]) for r in got] == [
        (1, 5, 5), (1, 0, 5), (1, 0, 5), (1, 0, 5), (1, -1, 4), (2, 3, 3),
    ]
    until = F.lit("2024-02-08 00:00:00").cast("timestamp_ntz")
    got = rows(stock.weekly_position(moves, "item", "ts", "q", until=until))
    assert [r[3] for r in got if r[0] == 2][-1] == datetime(2024, 2, 12, 8)
    assert [(r[0], r[4]) for r in got].count((2, 3)) == 5


def test_leads_of_unknown_stages_are_told(spark):
    leads = spark.createDataFrame(
        [("Frio", "maps"), ("lost", "maps"), (None, "maps"), ("Frio", "web")], "s STRING, o STRING"
    )
    got = crm.funnel(leads, "s", "o").collect()
    assert [(r.o, r.stage, r.n) for r in got if r.stage == "other"] == [("maps", "other", 2)]
    for origin in ("maps", "web"):
        assert abs(sum(r.share for r in got if r.o == origin) - 1) < 1e-5


@pytest.mark.parametrize("broadcast_bytes", [0, 10**9])
def test_a_query_of_another_length_spoils_nothing(spark, broadcast_bytes):
    corpus = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id INT, v ARRAY<FLOAT>")
    queries = spark.createDataFrame(
        [(100, [1.0, 0.0]), (101, [1.0, 2.0, 3.0]), (102, None)], "id INT, v ARRAY<FLOAT>"
    )
    got = knn_join(queries, corpus, 2, "id", "id", "v", broadcast_bytes=broadcast_bytes)
    assert [(r.query_id, r.corpus_id) for r in got.orderBy("rank").collect()] == [(100, 0), (100, 1)]


def test_lsh_widens_until_it_has_k(spark):
    random.seed(7)
    data = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(40)] + [(99, [0.0] * 8)]
    df = spark.createDataFrame(data, "id INT, v ARRAY<FLOAT>")
    query = data[0][1]
    for tables, bucket, k in ((2, 0.1, 10), (1, 0.05, 10), (1, 0.05, 60)):
        got = search.knn_lsh(df, query, k, "id", "v", tables, bucket).collect()
        assert len(got) == min(k, 40)
    assert search.knn_lsh(df, [0.0] * 8, 5, "id", "v").isEmpty()
