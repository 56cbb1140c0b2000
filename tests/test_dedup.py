import hashlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storeloom.functions.ttl_slices import keep_first, ttl_exits
from storeloom.operators.dedup import dedup_hash, dedup_ttl, first_by_key, last_by_key

START = datetime(2024, 1, 1)


def events(spark, triples):
    """(id, key, seconds) rows."""
    data = [(i, k, None if s is None else START + timedelta(seconds=s)) for i, k, s in triples]
    return spark.createDataFrame(data, "id BIGINT, k STRING, ts TIMESTAMP_NTZ")


def brute_force(triples, ttl):
    kept, anchor = set(), {}
    for i, k, s in sorted(triples, key=lambda t: (t[2], t[0])):
        if k not in anchor or s >= anchor[k] + ttl:
            anchor[k] = s
            kept.add(i)
    return kept


def ids(df):
    return {r.id for r in df.collect()}


def test_first_and_last_by_key(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 1, "n")], "k STRING, ts INT, v STRING"
    )
    assert rows(first_by_key(df, ["k"], ["ts"])) == [("a", 1, "y"), ("b", 1, None), (None, 1, "n")]
    assert ("a", 2, "x") in rows(last_by_key(df, ["k"], ["ts"]))
    assert rows(first_by_key(first_by_key(df, ["k"], ["ts"]), ["k"], ["ts"])) == rows(
        first_by_key(df, ["k"], ["ts"])
    )


def test_hash_is_sha256_of_body_and_key(spark):
    df = spark.createDataFrame([('{"a": "ç"}',)], "body STRING")
    got = df.select(dedup_hash(F.col("body"), F.lit("k1"))).first()[0]
    assert got == hashlib.sha256('{"a": "ç"}k1'.encode()).hexdigest()


def test_ttl_is_anchored_at_the_kept_row(spark):
    triples = [(1, "a", 0), (2, "a", 200), (3, "a", 299), (4, "a", 300), (5, "a", 599), (6, "a", 600)]
    # A gap-based rule would keep only the first.
    assert ids(dedup_ttl(events(spark, triples), "k", "ts", "id", 300)) == {1, 4, 6}


def test_ttl_lowest_id_of_an_instant_and_null_keys(spark):
    triples = [(9, "a", 0), (3, "a", 0), (4, None, 0), (5, None, 0), (6, "a", None)]
    out = dedup_ttl(events(spark, triples), "k", "ts", "id", 300)
    assert ids(out) == {3, 4, 5, 6}
    assert out.columns == ["id", "k", "ts"]


def test_ttl_twice_changes_nothing(spark):
    triples = [(i, "a", i * 37) for i in range(200)]
    once = dedup_ttl(events(spark, triples), "k", "ts", "id", 300)
    assert ids(dedup_ttl(once, "k", "ts", "id", 300)) == ids(once) == brute_force(triples, 300)


@pytest.mark.parametrize("slice_ttls", [1, 2, 8])
@pytest.mark.parametrize("ttl", [7, 60, 1000])
def test_ttl_equals_brute_force_with_a_hot_key(spark, slice_ttls, ttl):
    rng = np.random.default_rng(ttl)
    triples = [
        (i, "hot" if rng.random() < 0.5 else f"k{rng.integers(5)}", int(rng.integers(0, 5000)))
        for i in range(3000)
    ]
    want = brute_force(triples, ttl)
    for hot_rows in (0, 1000, 10**6):
        out = dedup_ttl(events(spark, triples), "k", "ts", "id", ttl, slice_ttls, hot_rows)
        assert ids(out) == want


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 150)), min_size=1, max_size=60),
    st.integers(1, 40),
    st.integers(1, 9),
)
def test_sorted_pass_over_any_batches(pairs, ttl, size):
    pairs = sorted(pairs)
    table = pa.table({"k": [k for k, _ in pairs], "n": range(len(pairs)), "_us": [s for _, s in pairs]})
    kept = [n for b in keep_first(iter(table.to_batches(max_chunksize=size)), "k", ttl) for n in b["n"].to_pylist()]
    triples = [(n, k, s) for n, (k, s) in enumerate(pairs)]
    assert set(kept) == brute_force(triples, ttl)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.integers(1, 60))
def test_exits_follow_the_chain(instants, ttl):
    at = np.array(sorted(instants), dtype=np.int64)
    for start, got in zip(at, ttl_exits(at, ttl)):
        last = start
        while (ahead := at[at >= last + ttl]).size:
            last = ahead[0]
        assert got == last
