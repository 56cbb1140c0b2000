from datetime import datetime, timedelta

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from storeloom.operators import ops, outbox, privacy, rates

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def ntz(ts):
    return F.lit(str(ts)).cast("timestamp_ntz")


def test_claim_is_disjoint_oldest_first_and_respects_attempts(spark):
    queue = spark.createDataFrame(
        [(i, "pendente" if i % 5 else "enviado", i % 4, at(1000 - i)) for i in range(300)],
        "id BIGINT, status STRING, tries INT, due TIMESTAMP_NTZ",
    )
    got = outbox.claim(queue, ntz(at(900)), 3, 7, "id", "due", "status", attempts="tries", max_attempts=3)
    claimed = got.collect()
    assert len({r.id for r in claimed}) == len(claimed) == 21
    for w in range(3):
        due = [i for i in range(100, 300) if i % 5 and i % 4 < 3 and i % 3 == w]
        want = sorted(due, key=lambda i: (1000 - i, i))[:7]
        assert [r.id for r in sorted(claimed, key=lambda r: r.turn) if r.worker == w] == want


def test_backlog(spark):
    queue = spark.createDataFrame(
        [("pendente", 0, at(0)), ("pendente", 0, at(86400 * 3)), ("enviado", 1, at(5))],
        "status STRING, tries INT, due TIMESTAMP_NTZ",
    )
    got = rows(outbox.backlog(queue, ntz(at(86400 * 2)), "due", "status", "tries"))
    assert got == [("enviado", 1, 1, 1, at(5), 2), ("pendente", 0, 2, 1, at(0), 2)]


def test_drain_plan_never_exceeds_the_limit(spark):
    requests = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat("id", F.lit(""))).alias("k")
    )
    plan = outbox.drain_plan(requests, "k", ["id"], F.floor(F.col("id") / 64), 10, hot_rows=100)
    assert plan.count() == 1000
    per_slot = plan.groupBy("k", "slot").count()
    assert per_slot.agg(F.max("count")).first()[0] == 10
    assert plan.filter("k = 'hot'").agg(F.max("slot")).first()[0] == 33


def test_tumbling_limits_at_three_levels(spark):
    data = [("s1", "ip1", "a", at(i)) for i in range(101)] + [("s2", "ip1", "a", at(60))]
    requests = spark.createDataFrame(data, "shop STRING, ip STRING, app STRING, ts TIMESTAMP_NTZ")
    got = {(r.level, r.key, r.window_start): r for r in rates.rate_tumbling(requests, "ts").collect()}
    assert got["shop", "s1", at(0)].requests == 60
    assert got["shop", "s1", at(0)].breach_code is None
    assert got["app", "a", at(60)].requests == 42
    hourly = rates.rate_tumbling(requests, "ts", width="1 hour").collect()
    assert {(r.level, r.key): r.breach_code for r in hourly} == {
        ("shop", "s1"): 633,
        ("shop", "s2"): None,
        ("ip", "ip1"): None,
        ("app", "a"): None,
    }


def test_rolling_counts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [
        (i, "hot" if rng.random() < 0.5 else f"k{rng.integers(4)}", int(rng.integers(0, 2000)))
        for i in range(1500)
    ]
    df = spark.createDataFrame(
        [(i, k, at(s)) for i, k, s in data], "id INT, k STRING, ts TIMESTAMP_NTZ"
    )
    for key, hot_rows in (("k", 10**6), ("k", 300), ("k", 0), (None, 10**6)):
        counted = rates.rate_rolling(df, "ts", 60, 5, key, hot_rows).collect()
        got = {r.id: (r.in_window, r.breached) for r in counted}
        for i, k, s in data:
            n = sum(1 for _, k2, s2 in data if s - 60 < s2 <= s and (key is None or k2 == k))
            assert got[i] == (n, n > 5)


def test_rolling_window_is_open_at_its_far_end(spark):
    df = spark.createDataFrame(
        [(1, "k", at(0)), (2, "k", at(60)), (3, "k", None), (4, None, at(5)), (5, None, at(6))],
        "id INT, k STRING, ts TIMESTAMP_NTZ",
    )
    got = {r.id: r.in_window for r in rates.rate_rolling(df.filter("k = 'k'"), "ts", 60, 1).collect()}
    assert got == {1: 1, 2: 1, 3: None}
    for hot_rows in (0, 2, 10**6):
        got = {r.id: r.in_window for r in rates.rate_rolling(df, "ts", 60, 1, "k", hot_rows).collect()}
        assert got == {1: 1, 2: 1, 3: None, 4: 1, 5: 2}


def test_refusal_modes(spark):
    said = ["Parar", "  sair!", "CANCELAR.", "quero parar", "parar agora", "¡Sair", "", None, "pararam"]
    df = spark.createDataFrame([(s,) for s in said], "text STRING")
    whole = [r[0] for r in df.select(privacy.refusal(F.col("text"))).collect()]
    assert whole == [True, True, True, False, False, True, False, False, False]
    token = [r[0] for r in df.select(privacy.refusal(F.col("text"), mode="first_token")).collect()]
    assert token == [True, True, True, False, True, True, False, False, False]


def test_optouts_and_erase_are_idempotent(spark):
    messages = spark.createDataFrame(
        [("a", "Sair", 2), ("a", "parar", 1), ("b", "oi", 1)], "who STRING, text STRING, ts INT"
    )
    out = privacy.optouts(messages, "who", "text", "ts")
    assert rows(out) == [("a", 1, 2)]
    people = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 2), ("b", "z", 3), (None, "n", 4)], "who STRING, mail STRING, n INT"
    )
    once = privacy.erase(people, out.unionByName(out), "who", ["mail"])
    assert rows(once) == [("a", None, 1), ("a", None, 2), ("b", "z", 3), (None, "n", 4)]
    assert rows(privacy.erase(once, out, "who", ["mail"])) == rows(once)


def test_scrub_at_the_thirty_day_edge(spark):
    as_of = datetime(2024, 3, 1)
    edge = as_of - timedelta(days=30)
    leads = spark.createDataFrame(
        [
            (1, "m", edge),
            (2, "m", edge - timedelta(microseconds=1)),
            (3, "m", datetime(2020, 1, 1)),
            (4, "m", None),
        ],
        "id INT, mail STRING, captured TIMESTAMP_NTZ",
    )
    activity = spark.createDataFrame([(3, edge), (3, datetime(2021, 1, 1))], "id INT, at TIMESTAMP_NTZ")
    once = privacy.scrub_inactive(leads, activity, "id", "captured", "at", ntz(as_of), ["mail"])
    assert {r.id: (r.mail, r.inactive) for r in once.collect()} == {
        1: ("m", False),
        2: (None, True),
        3: ("m", False),
        4: ("m", False),
    }
    again = privacy.scrub_inactive(
        once.drop("inactive"), activity, "id", "captured", "at", ntz(as_of), ["mail"]
    )
    assert rows(again) == rows(once)


def test_pii_residue(spark):
    df = spark.createDataFrame(
        [(True, "x", "call +55 21 99999-8888"), (True, None, "a.b@c.com"), (False, "y", "v1.2 @home")],
        "gone BOOLEAN, mail STRING, note STRING",
    )
    got = privacy.pii_residue(df, F.col("gone"), ["mail"], ["note"]).collect()
    assert {r.check_name: r.n_rows for r in got} == {
        "not_erased": 1,
        "email_in_text": 1,
        "phone_in_text": 1,
    }


def test_failures_match_case_sensitively(spark):
    df = spark.createDataFrame(
        [("m1", "Error 404"), ("m1", "404 Not Found"), ("m2", "500"), ("m3", None)], "id STRING, e STRING"
    )
    assert rows(ops.failure_counts(df, "id", "e")) == [("m1", 2)]


def test_prune_by_age_then_newest(spark):
    as_of = datetime(2024, 2, 1)
    data = [(i, as_of - timedelta(hours=i)) for i in range(1000)] + [
        (5000 + i, as_of - timedelta(hours=3)) for i in range(5)
    ]
    df = spark.createDataFrame(data, "id BIGINT, ts TIMESTAMP_NTZ")
    got = {r.id for r in ops.prune(df, "ts", "id", ntz(as_of), 14, 6).collect()}
    assert got == {0, 1, 2, 5002, 5003, 5004}
    # Exactly 14 days old is no longer younger than 14 days.
    assert ops.prune(df, "ts", "id", ntz(as_of), 14, 10**6).count() == 14 * 24 + 5
    assert ops.prune(df.limit(0), "ts", "id", ntz(as_of)).isEmpty()


def test_rate_limit_log(spark):
    df = spark.createDataFrame(
        [
            ("a", 1, "rate limit exceeded"),
            ("a", 2, "x acme: error: 429 retry after 2024-01-01 02:30:00 UTC: y"),
            ("a", 3, "all fine"),
            ("b", 1, "too many certificates (5) issued"),
            ("c", 1, "ACME: error: 429"),
            ("d", 1, "ok"),
            ("e", 1, "retry after 2024-99-99 00:00:00 UTC"),
        ],
        "src STRING, n INT, line STRING",
    )
    got = {r.src: (r.n_lines, r.retry_at_utc, r.retry_local, r.reason) for r in ops.rate_limit_log(df, "src", "n", "line").collect()}
    assert got == {
        "a": (2, datetime(2024, 1, 1, 2, 30), "31/12/2023 às 23:30:00", None),
        "b": (1, None, None, "too many certificates (5) issued"),
        "c": (1, None, None, "Bloqueio ACME 429"),
        "e": (1, None, "2024-99-99 00:00:00 (UTC)", None),
    }
