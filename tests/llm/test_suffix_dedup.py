import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.odd import empty_docs, odd_docs, odd_rows, sha, stored
from pyspark.sql import functions as F

from storeloom.llm.suffix_dedup import substring_dedup
from storeloom.llm.suffix_sort import deep_shallow


def plain(rows):
    """By a set of all windows; rows in order of id, equal rows count once."""
    seen, out = set(), {}
    for i, data in rows:
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for q in range(len(data)) if gone[q] and (not q or not gone[q - 1]))
        out[i, data] = (len(data), sum(gone), spans, sha(kept))
    return out


def run(df, **k):
    out = substring_dedup(df, **k)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")
    ).collect()


@pytest.mark.parametrize("group_rows", [250_000, 5, 1])
def test_shared_passages(spark, tmp_path, group_rows):
    random.seed(2)
    base = ["".join(random.choices("abcdé ", k=random.randint(50, 400))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(random.randint(0, 8)):
            if random.random() < 0.6:
                parts.append(random.choice(base)[random.randint(0, 60) :][: random.randint(30, 300)])
            else:
                parts.append("".join(random.choices("xyz é", k=random.randint(1, 80))))
        rows.append((i * 7, "".join(parts)))
    rows += [(5000, "a" * 1000), (5001, "ab" * 300), (5002, "a" * 150), (5003, base[0] * 40)]
    want = plain([(i, t.encode()) for i, t in rows])
    got = run(stored(spark, tmp_path / "d", rows), group_rows=group_rows)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[1:]) == want[r.doc_id, texts[r.doc_id].encode()]


def test_odd_documents(spark, tmp_path):
    got = run(odd_docs(spark, tmp_path / "d"))
    assert len(got) == len(odd_rows())
    once = dict.fromkeys((i, (t or "").encode()) for i, t in odd_rows())
    # Rows without an id come last; which of several rows of one id is first is a matter
    # of their hash, and here their texts are too short to share anything.
    order = sorted(once, key=lambda r: (r[0] is None, r[0] or 0))
    want = plain(order)
    left = {(i, *want[i, (t or "").encode()]) for i, t in odd_rows()}
    assert {tuple(r) for r in got} == left


def test_many_rows_of_one_id_and_without_id(spark, tmp_path):
    random.seed(9)
    shared = ["".join(random.choices("abcdefgh ", k=150 + 20 * i)) for i in range(12)]

    def text():
        parts = [random.choice(shared) if random.random() < 0.3 else "".join(random.choices("klmno ", k=40))]
        return "".join(parts + ["".join(random.choices("pqrst ", k=random.randint(0, 90)))] + [random.choice(shared)])

    rows = [(7, text()) for _ in range(1000)] + [(None, text()) for _ in range(1000)]
    rows += [(7, rows[3][1]), (None, rows[1500][1]), (None, None), (None, ""), (8, rows[1][1])]
    once = dict.fromkeys((i, (t or "").encode()) for i, t in rows)
    order = sorted(once, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1]).digest()))
    want = plain(order)
    got = Counter(tuple(r) for r in run(stored(spark, tmp_path / "d", rows)))
    assert got == Counter((i, *want[i, (t or "").encode()]) for i, t in rows)


def test_empty_table(spark, tmp_path):
    assert run(empty_docs(spark, tmp_path / "d")) == []


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_deep_shallow_sorts(letters):
    rng = np.random.default_rng(letters)
    rows = rng.integers(0, letters, (1500, 70), dtype=np.uint8)
    rows[::3, :50] = rows[0, :50]
    groups = np.sort(rng.integers(0, 3, len(rows)))
    order, lcp = deep_shallow(rows, groups)
    keys = [(groups[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(rows)))
    for i in range(1, len(rows)):
        (ga, a), (gb, b) = keys[i - 1], keys[i]
        shared = next((k for k in range(70) if a[k] != b[k]), 70)
        assert lcp[i] == (shared if ga == gb else -1)
