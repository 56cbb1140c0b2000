import math
import random

import numpy as np
import pytest
from llm.odd import stored

from storeloom.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, _key string, n int, component string"


def plain(rows, components=4, weight="one"):
    """Everything in one place, sums and deviations in whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(v) for _, v in kept if v}:
        own = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in kept if len(v) == d]
        fit = sorted({x for _, x in own}) if weight == "one" else [x for _, x in own]
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        mean = np.array([s / n for s in sums])
        centred = np.array(fit, float) - mean
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        for i, x in own:
            dev = sum((n * e - s) ** 2 for e, s in zip(x, sums))
            for k in range(min(components, d)):
                if values[k] > 1e-12 * values[0] > 0:
                    z = float((np.array(x, float) - mean) @ vectors[:, k] / math.sqrt(values[k]))
                    out.setdefault((i, k + 1, n, dev), []).append((z, values[k] / values.sum()))
    return out


def same(got, want):
    found = {}
    for r in got:
        assert r.identity_error < 1e-9
        found.setdefault((r.vec_id, r.component, r.n, int(r.deviation)), []).append((r.whitened, r.explained))
    assert set(found) == set(want)
    signs = {}
    for key in want:
        a, b = sorted(found[key]), sorted(want[key])
        assert len(a) == len(b)
        if len(a) > 1 and not np.allclose(a, b, atol=1e-8):
            b = sorted((-z, e) for z, e in b)
        for (z, e), (y, f) in zip(a, b):
            assert abs(abs(z) - abs(y)) < 1e-8 and abs(e - f) < 1e-9
            if len(a) == 1 and abs(y) > 1e-6:
                signs.setdefault((key[2], key[1]), set()).add(round(z / y))
    return signs


def vectors(seed=1, n=400, d=9):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    rows = [(i, list(map(float, rng.normal(size=d) @ mix))) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a third of all rows
    return rows + [(3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("weight", ["one", "count"])
def test_equals_the_whole_in_one_place(spark, tmp_path, weight):
    rows = vectors()
    df = stored(spark, tmp_path / "v", rows, "vec_id long, embedding array<double>")
    signs = same(whiten(df, weight=weight).collect(), plain(rows, weight=weight))
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 4


def test_odd_vectors(spark, tmp_path):
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 2.0]), (5, [float("inf"), 0.0, 0.0])]
    rows += [(10 + i, [0.1 * i, -0.2 * i * i, 0.01]) for i in range(9)] + [(None, [0.5, 0.5, -0.0])]
    rows += [(30, [1.0, 2.0]), (31, [1.5, -2.0]), (32, [1.5, -2.0]), (40, [7.0])]
    rows += [(50 + i, [1e7 * i, 1.0 * (i % 3), 0.0, 3.0]) for i in range(6)]
    odd = [(i, v, "x", 1, "y") for i, v in rows]
    got = whiten(stored(spark, tmp_path / "v", odd, SCHEMA)).collect()
    random.seed(2)
    same(got, plain(rows))
    assert {r.vec_id for r in got} == {None, 30, 31, 32, *range(10, 19), *range(50, 56)}


def test_empty_table(spark, tmp_path):
    assert whiten(stored(spark, tmp_path / "v", [], SCHEMA)).collect() == []


def test_floats_are_taken_as_doubles(spark, tmp_path):
    rows = [(i, [float(np.float32(0.1 * i)), float(np.float32(-0.37 * i * i))]) for i in range(20)]
    df = stored(spark, tmp_path / "v", rows, "vec_id long, embedding array<float>")
    same(whiten(df).collect(), plain(rows))


def test_entries_too_large_for_longs(spark, tmp_path):
    rows = [(i, [1e15 * i, 2e15 * (i % 2)]) for i in range(8)]
    got = whiten(stored(spark, tmp_path / "v", rows, "vec_id long, embedding array<double>")).collect()
    same(got, plain(rows))
